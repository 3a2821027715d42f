"""Query catalogs of the core."""

from .formats import CATALOG as _FORMATS
from .graphs import CATALOG as _GRAPHS
from .quality import CATALOG as _QUALITY
from .timing import CATALOG as _TIMING

CATALOGS = (_GRAPHS, _TIMING, _QUALITY, _FORMATS)
