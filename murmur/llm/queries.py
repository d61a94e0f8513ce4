"""Each operator over its whole table, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.scale import scratch_path
from murmur.llm import bpe, centroids, contentsort, decontaminate, fim, html, langid, lm, neardup, quality, sharding, tokenfiles, urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules that the URL query is asked to apply.
SITE_RULES = (
    urls.SiteRule("allow", "org", "/"),
    urls.SiteRule("block", "example.org", "/es/"),
    urls.SiteRule("block", "example.org", "/en/1"),
    urls.SiteRule("allow", "com", "/fr/"),
    urls.SiteRule("block", "com", "/de/"),
)
GLOB_RULES = (
    urls.GlobRule("block", "{sub}ads-track.*"),
    urls.GlobRule("block", "{sub}cheap-pills.*"),
    urls.GlobRule("block", "{sub}free-bets.*"),
    urls.GlobRule("block", "*/login*"),
    urls.GlobRule("block", "*/cart/*"),
    urls.GlobRule("block", "*.exe"),
    urls.GlobRule("block", "*.zip"),
)

OP2_SQL = """
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
split as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
rules(verdict, rhost, rpath) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
globs(pos, glob_rule, pattern) as (values
  (1, '{sub}ads-track.*', '([^/]*[.])?ads-track[.].*'), (2, '{sub}cheap-pills.*', '([^/]*[.])?cheap-pills[.].*'),
  (3, '{sub}free-bets.*', '([^/]*[.])?free-bets[.].*'), (4, '*/login*', '.*/login.*'), (5, '*/cart/*', '.*/cart/.*'),
  (6, '*.exe', '.*[.]exe'), (7, '*.zip', '.*[.]zip')),
sites as (
  select s.page_id, s.host, s.path, r.rhost || r.rpath as rule, r.verdict
  from split s left join rules r
    on (s.host = r.rhost or ends_with(s.host, '.' || r.rhost)) and starts_with(s.path, r.rpath)
  qualify row_number() over (partition by s.page_id order by length(r.rhost || r.rpath) desc nulls last) = 1),
judged as (
  select s.*, g.glob_rule
  from sites s left join globs g on regexp_full_match(s.host || s.path, g.pattern, 's')
  qualify row_number() over (partition by s.page_id order by g.pos nulls last) = 1)
select page_id, host, path, rule, glob_rule,
       coalesce(verdict, case when glob_rule is null then 'allow' else 'block' end) as verdict
from judged
"""


@query("op2_url_filters", OP2_SQL)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), SITE_RULES, GLOB_RULES)


OP8_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
grams as (
  select doc_id, i, array_to_string(words[i:i + 7], ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
twice as (select doc_id, i from grams qualify count(*) over (partition by doc_id, gram) > 1),
covered as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 8)) as p from twice) group by doc_id),
lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from w)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
measured as (
  select w.doc_id, len(words)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join covered using (doc_id) left join lines using (doc_id)),
bits as (
  select *, (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
    + case when 10 * n_symbols > n_words then 4 else 0 end
    + case when n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines then 8 else 0 end
    + case when word_chars > 20 * n_words then 16 else 0 end
    + case when word_chars < 2 * n_words then 32 else 0 end)::bigint as failed_bits
  from measured)
"""
OP8_ROWS = """select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits,
       failed_bits & 3 <> 0 as base_failed, failed_bits = 0 as kept, failed_bits & 23 = 0 as kept_by_first
from bits
"""


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[quality.Rule, ...]]:
    """The ledger of all documents, stored and read back: policies and ablations look at no text."""
    path = quality.store(quality.ledger(table(spark, sf_dir, "documents")), scratch_path(spark, "quality-ledger"))
    return quality.load(spark, path)


@query("op8_quality_rules", OP8_SQL + OP8_ROWS)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, rules = _ledger(spark, sf_dir)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits",
        quality.fails(quality.BASE, rules).alias("base_failed"), (~quality.fails(quality.STRICT, rules)).alias("kept"),
        (~quality.fails(quality.FIRST, rules)).alias("kept_by_first"))


POLICIES = (quality.BASE, quality.FIRST, quality.STRICT)
ABLATION_ROWS = " union all ".join(
    f"select '{p.version}' as version, '{r}' as rule, count(*) filter (where failed_bits & {quality.mask(quality.Policy('', (r,)))} <> 0) as failing, "
    f"count(*) filter (where failed_bits & {quality.mask(p)} = {quality.mask(quality.Policy('', (r,)))}) as only, "
    f"count(*) filter (where failed_bits & {quality.mask(p)} = 0) as kept from bits" for p in POLICIES for r in p.rules)


@query("quality_ablations", OP8_SQL + ABLATION_ROWS)
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of three versions of the policy drops, from the stored ledger."""
    entries, rules = _ledger(spark, sf_dir)
    return quality.ablations(entries, POLICIES, rules)


SHARDS = 24


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = sharding.assign(
        table(spark, sf_dir, "documents"), sharding.topology(SHARDS), grown=sharding.topology(SHARDS + 1))
    return assigned.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP4_SETTINGS = neardup.Settings(width=3, percent=85)


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), OP4_SETTINGS)


TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2


def tokenizer_text(path: str | None = None) -> str:
    """A tokenizer file's text; its place is a parameter, by default that of the public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER_FILE)
    with open(path, encoding="utf-8") as file:
        return file.read()


@query("op5_bpe_round_trip")
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, vocabulary = table(spark, sf_dir, "documents"), tokenizer_text()
    encoded = bpe.encode(documents, vocabulary, bpe.build_lexicon(documents, vocabulary), decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, tokenizer_text(), END_ID)
    return tokenfiles.read(spark, path, with_ids=False)


OP1_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
sizes as (select doc_id, len(words)::bigint as n_words, sum(len(words)) over () as total from w),
placed as (select doc_id, i, words[i] as word, case when i > 1 then words[i - 1] end as prior
       from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from w)),
u as (select word, count(*) as n from placed group by word),
ud as (select doc_id, word, count(*) as n from placed group by doc_id, word),
b as (select prior, word, count(*) as n from placed where prior is not null group by prior, word),
bd as (select doc_id, prior, word, count(*) as n from placed where prior is not null group by doc_id, prior, word),
own as (select ud.doc_id, ud.word, u.n - ud.n as n from ud join u using (word)),
pairs as (select bd.doc_id, bd.prior, bd.word, b.n - bd.n as n from bd join b using (prior, word)),
steps as (
  select placed.doc_id, coalesce(pairs.n, 0) > 0 as seen, placed.prior is not null and coalesce(pairs.n, 0) = 0 as stepped,
    case when coalesce(pairs.n, 0) > 0 then ln(pairs.n / context.n)
         else ln(greatest(own.n, 0.5) / greatest(sizes.total - sizes.n_words, 1))
              + case when placed.prior is null then 0 else ln(0.4) end end as part
  from placed join sizes using (doc_id) join own using (doc_id, word)
  left join pairs on pairs.doc_id = placed.doc_id and pairs.prior = placed.prior and pairs.word = placed.word
  left join own context on context.doc_id = placed.doc_id and context.word = placed.prior)
select s.doc_id, s.n_words, count(*) filter (where stepped) as n_backoffs, round(coalesce(sum(part), 0.0::double), 4) as log_score,
       case when s.n_words > 0 then round(sum(part) / s.n_words, 6) end as score
from sizes s left join steps using (doc_id) group by s.doc_id, s.n_words
"""


@query("op1_lm_scoring", OP1_SQL)
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backoffs", F.round("log_score", 4).alias("log_score"),
                         F.round("score", 6).alias("score"))


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


@query("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(~langid.held_out(F.col("doc_id"))))
    predicted = langid.predict(documents, model)
    return predicted.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


OP11_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    sha256('42:' || doc_id::varchar) as hex
  from documents),
h as (
  select doc_id, text, units, len(units)::bigint as n,
    ('0x' || hex[1:8])::bigint as h1, ('0x' || hex[9:16])::bigint as h2,
    ('0x' || hex[17:24])::bigint as h3, ('0x' || hex[25:32])::bigint as h4
  from t),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50
         then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from h),
p as (
  select doc_id, n, form, text, array_to_string(units[1:a], '') as prefix,
    array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix
  from c)
select doc_id, n, form,
  case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def _op12_sql(k: int, rounds: int) -> str:
    """The rounds written out one after another."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
  select v.vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
  from v cross join c{r} c qualify row_number() over (partition by v.vec_id order by d, c.c) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} as (select c, i, sum(x)::bigint as s, count(*) as n
  from (select c, unnest(q) as x, unnest(range(1, 65)) as i from a{r}) group by c, i),
c{r + 1} as materialized (
  select c{r}.c, coalesce(f.q, c{r}.q) as q from c{r}
  left join (select c, list((s - ((s % n) + n) % n) // n order by i) as q from m{r} group by c) f using (c))""")
    return f"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (
  select row_number() over (order by sha256('3:' || vec_id::varchar)) - 1 as c, q from v qualify c < {k}),{",".join(steps)}
select a.vec_id, a.c::int as cluster, a.d as distance, sum(a.d) over (partition by a.c)::bigint as cluster_inertia,
  sum(a.d) over ()::bigint as inertia, sha256(array_to_string(f.q, ',')) as centroid_sha256
from a{rounds} a join c{rounds} f using (c)
"""


OP12_SETTINGS = centroids.Settings(k=8, rounds=10)


@query("op12_centroid_clustering", _op12_sql(OP12_SETTINGS.k, OP12_SETTINGS.rounds))
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), OP12_SETTINGS)


OP13_SQL = """
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(text) as text_sha256
from t window same as (partition by text)
"""


@query("op13_exact_dedup", OP13_SQL)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.classes(table(spark, sf_dir, "documents"), keep="largest")
