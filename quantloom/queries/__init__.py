"""All queries over the panel views, and their SQL."""

from quantloom.queries import candidates, cross_section, daily, evaluation, factor_sql, factors, features, intraday, joins, minute_stats, models, more, regime, rolling, stores, tables  # noqa: F401
from quantloom.queries.common import QUERIES, SQL  # noqa: F401
