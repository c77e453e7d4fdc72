"""The column functions of the library, in one place."""

from tidemark.operators.asof import within
from tidemark.operators.book import guarded
from tidemark.operators.features import integer_features, scaled
from tidemark.operators.labels import asymmetry, mid2, mid_price, relative_spread
from tidemark.operators.models import log_loss
from tidemark.operators.normalise import event_type, rescaled
from tidemark.operators.validate import accuracy, hit, tier

__all__ = [
    "accuracy", "asymmetry", "event_type", "guarded", "hit", "integer_features", "log_loss", "mid2", "mid_price",
    "relative_spread", "rescaled", "scaled", "tier", "within",
]
