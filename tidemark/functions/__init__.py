"""Column functions of the library in one place."""

from ..operators.indicators import bias_label, change, signed
from ..operators.news import any_word, long_enough, news_points, normalize, published_ts, shorten, strip, strip_tags, title_keywords
from ..operators.registry import device_slots, fingerprint, license_status
from ..operators.scores import nowcast_label

__all__ = [
    "any_word",
    "bias_label",
    "change",
    "device_slots",
    "fingerprint",
    "license_status",
    "long_enough",
    "news_points",
    "normalize",
    "nowcast_label",
    "published_ts",
    "shorten",
    "signed",
    "strip",
    "strip_tags",
    "title_keywords",
]
