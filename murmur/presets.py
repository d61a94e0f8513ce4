"""A ready-made study: one national team's lost final and won final, 2023-24.

These values are inputs, not logic. Pass them to the operators, or pass your own.
"""

from __future__ import annotations

from datetime import datetime

from murmur.functions.words import ENGLISH_STOP_WORDS
from murmur.specs import Calendar, EntityPattern, Period, TopicFilter
from murmur.study import Event, Study

# Forum names that make up the topic.
CRICKET_TOPIC = TopicFilter([
    "Cricket", "CricketShitpost",
    "IndianCricket", "IndianCricketTeam", "bcci", "cricketindia", "indiacricket",
    "ipl",
    "ChennaiSuperKings", "csk",
    "RoyalChallengers", "RCB",
    "MumbaiIndians", "mi",
    "KolkataKnightRiders", "KKR",
    "SunrisersHyderabad", "srh",
    "DelhiCapitals", "delhicapitals", "dc",
    "PunjabKingsIPL", "pbks",
    "RajasthanRoyals", "rr",
    "LucknowSuperGiants", "lsg",
    "GujaratTitans", "gt",
    "Dhoni", "MSDhoni",
    "Kohli", "ViratKohli", "Virat",
    "RohitSharma", "Hitman",
    "PakCricket",
    "AusCricket", "cricketaustralia",
    "EngCricket", "englandcricket",
    "NZCricket",
    "TestCricket", "Ashes", "ICC", "t20worldcup",
])

# Terms that count as a mention, and each player's home forums.
CRICKET_ENTITIES = [
    EntityPattern("Dhoni", ["dhoni", "msd", "mahi", "thala", "captain cool"],
                  home_forums=["ChennaiSuperKings"]),
    EntityPattern("Kohli", ["kohli", "virat", "king kohli", "chase master"],
                  home_forums=["RoyalChallengers", "RCB"]),
    EntityPattern("Rohit", ["rohit", "sharma", "hitman", "ro", "rohit sharma"],
                  home_forums=["MumbaiIndians"]),
]

# Event periods. An inclusive end at midnight admits one instant of that day.
CRICKET_CALENDAR = Calendar([
    Period("wc2023_group_stage", datetime(2023, 10, 5), datetime(2023, 11, 19)),
    Period("wc2023_final_aftermath", datetime(2023, 11, 19), datetime(2023, 11, 26), end_inclusive=True),
    Period("ipl2024", datetime(2024, 3, 22), datetime(2024, 5, 26), end_inclusive=True),
    Period("t20wc2024_group_stage", datetime(2024, 6, 1), datetime(2024, 6, 29)),
    Period("t20wc2024_final_aftermath", datetime(2024, 6, 29), datetime(2024, 7, 6), end_inclusive=True),
])

# Display names for the two aftermaths that are compared.
CRICKET_HEAD_TO_HEAD = {
    "wc2023_final_aftermath": "2023 WC Final (Loss)",
    "t20wc2024_final_aftermath": "2024 T20 Final (Win)",
}

# Substrings used to discover further forum names.
CRICKET_KEYWORDS = [
    "cricket", "ipl", "kohli", "dhoni", "rohit", "csk", "rcb", "mumbaiindians",
    "kkr", "delhicapitals", "punjabkings", "rajasthanroyals", "sunrisers",
    "lucknowsupergiants", "gujarattitans", "hitman", "virat", "mahi",
    "thala", "msd", "t20", "odi", "testcricket", "wcc", "cwc", "rr", "srh",
    "rohitsharma", "IndiaCricket", "CricketShitpost",
]

# Domain words removed before topic modelling.
CRICKET_STOP_WORDS = [
    "cricket", "match", "game", "play", "played", "player", "team",
    "india", "indian", "like", "just", "good", "great", "really",
    "think", "know", "get", "one", "also", "would", "could", "even",
    "run", "runs", "ball", "balls", "over", "overs",
]

#: The whole study, for ``murmur.study``; topics leave out the domain words as well as the common ones.
CRICKET_STUDY = Study(
    CRICKET_TOPIC, CRICKET_ENTITIES, CRICKET_CALENDAR,
    [Event("wc2023", "wc2023_group_stage", "wc2023_final_aftermath", "wc2023_final_aftermath"),
     Event("t20wc2024", "t20wc2024_group_stage", "t20wc2024_final_aftermath", "t20wc2024_final_aftermath")],
    CRICKET_HEAD_TO_HEAD, [*ENGLISH_STOP_WORDS, *CRICKET_STOP_WORDS])
