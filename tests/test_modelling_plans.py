"""Queries on models that must not come back to the posts for each figure."""

import datetime

from murmur.operators import models
from murmur.plans import modelling


def test_the_fixed_silhouette_profiles_the_posts_once(spark, tmp_path, monkeypatch):
    start = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i, f"this text {'and rewh' if i % 3 else ''}", "en", f"src{i % 4}", 20 + i % 7) for i in range(240)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, start + datetime.timedelta(hours=i), i % 9, float(i % 13)) for i in range(240)],
                          "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    plain = models.standardised
    monkeypatch.setattr(models, "standardised", lambda profile, columns: seen.extend(profile.inputFiles()) or plain(profile, columns))
    rows = modelling.silhouette_fixed(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and -1 <= rows[0]["silhouette"] <= 1
    assert seen and not any("documents.parquet" in path for path in seen)
