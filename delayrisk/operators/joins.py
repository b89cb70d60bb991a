"""A left outer join that stays balanced when the right side has a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_fanout(left: DataFrame, right: DataFrame, key: str,
                     keys: DataFrame | None = None, null_keys: bool = True,
                     right_keys: DataFrame | None = None) -> DataFrame:
    """``left`` left-joined to ``right`` on ``key``, written so no key is stuck in one task.

    With AQE, a left outer join can split only its left side; if one key
    holds a third of the right side's rows, that key's task does a third of
    the join.  Here the work is one *inner* equi-join, which AQE may split on
    either side, against the right rows plus one null-padded row for every
    key with no right row.  Those keys are the left's distinct keys (a
    key-only plan that Catalyst prunes) minus the right's distinct keys.
    ``keys`` may supply any frame whose ``key`` column covers the left's
    keys (say the id spine): padded rows of other keys match nothing.
    ``right_keys`` may supply a cheaper frame with exactly the right's
    non-null keys, when the caller knows one.
    Left rows with a null key, which a left join keeps with nulls, come from
    a filtered branch; the ``IS NULL`` filter reaches the scans, so when the
    key is never null that branch reads next to nothing.  A caller whose
    left keys cannot be null passes ``null_keys=False`` and the left is
    planned once.
    """
    extra = [f for f in right.schema.fields if f.name != key]
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in extra]
    right_rows = right.filter(F.col(key).isNotNull())
    left_keys = (keys if keys is not None else left).select(key).distinct()
    present = (right_keys if right_keys is not None else right_rows).select(key)
    missing = left_keys.filter(F.col(key).isNotNull()).join(
        present.filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    side = right_rows.unionByName(missing.select(key, *nulls))
    matched = left.join(side, key, "inner").select(*left.columns, *[f.name for f in extra])
    if not null_keys:
        return matched
    null_rows = left.filter(F.col(key).isNull()).select(*left.columns, *nulls)
    return matched.unionByName(null_rows)
