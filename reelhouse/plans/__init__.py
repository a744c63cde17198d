"""Query plans: each module registers builders (and oracles) into ``registry``."""

from . import registry  # noqa: F401
from . import catalog_queries  # noqa: F401
from . import rbac_queries  # noqa: F401
from . import write_queries  # noqa: F401
from . import machine_queries  # noqa: F401
from . import commit_queries  # noqa: F401
from . import progress_queries  # noqa: F401
from . import stream_queries  # noqa: F401
from . import asset_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
