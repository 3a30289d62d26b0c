from tidewell.operators.aggregate import Agg, group_by, order_groups
from tidewell.operators.cells import count_long_cells, truncate_cells
from tidewell.operators.join import join
from tidewell.operators.limits import head, page, row_limit, sort_rows
from tidewell.operators.project import filter_rows, limit_columns, rename, select_existing, transform, truthy
from tidewell.operators.union import concat

__all__ = [
    "Agg", "concat", "count_long_cells", "filter_rows", "group_by", "head", "join", "limit_columns",
    "order_groups", "page", "rename", "row_limit", "select_existing", "sort_rows", "transform",
    "truncate_cells", "truthy",
]
