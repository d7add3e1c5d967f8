from trialframe.sources.files import (  # noqa: F401
    DEVELOPMENT,
    GAS_EXCHANGE,
    OBSERVATIONS,
    read_csv,
    read_parquet,
    snake_case,
)
from trialframe.sources.tables import (  # noqa: F401
    expand_levels,
    factor_grid,
    literal_table,
    spaced_offsets,
)
