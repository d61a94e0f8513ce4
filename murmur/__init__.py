"""Community-reaction analytics on Spark DataFrames."""

from murmur.specs import Calendar, EntityPattern, Period, TopicFilter

__all__ = ["Calendar", "EntityPattern", "Period", "TopicFilter"]
