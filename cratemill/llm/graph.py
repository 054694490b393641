"""Connected components, as the corpus operators call them; the other operators use them too, so the code lies in cratemill.graph."""

from cratemill.graph import FEW, components, hot_or_none, split_join  # noqa: F401
