"""All registered queries, by family."""

from checks.queries import cleaning, extraction, models, plans, sampling, sources, statistics  # noqa: F401
from checks.queries.statistics import top_makes  # noqa: F401
