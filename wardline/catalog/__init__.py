"""Registered queries: every operator over the test tables, with an SQL oracle where there is one."""

from wardline.catalog.registry import REGISTRY  # noqa: F401
from wardline.catalog import basics, detect, report  # noqa: F401
