"""Small groups by the batch, against groups of the whole column, whatever the batches."""

import contextlib
import io
import random

import pyarrow as pa

from wayloom.operators.runs import whole_groups
from wayloom.plans import catalog


def test_groups_stay_whole_across_batches():
    rng = random.Random(5)
    for _ in range(300):
        keys = sorted(rng.choices([None, *range(rng.choice([1, 2, 6, 30]))], k=rng.randrange(1, 40)), key=lambda k: (k is not None, k))
        rows = [{"k": k, "v": n} for n, k in enumerate(keys)]
        kind = pa.schema([("k", pa.int64()), ("v", pa.int64())])
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randrange(6)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        got = []
        for table, at in whole_groups((pa.RecordBatch.from_pylist(p, schema=kind) for p in parts), "k"):
            at_rows = table.to_pylist()
            got += [at_rows[a:b] for a, b in zip(at, at[1:], strict=False)]
            assert at[0] == 0 and at[-1] == len(at_rows)
        want = [[r for r in rows if r["k"] == k] for k in dict.fromkeys(keys)]
        assert got == want


def test_small_groups_have_no_frame_each(spark, sf):
    for name in ("op_plan_04_hard_constraints", "op_plan_06_local_improvement", "op_plan_07_routed_order", "op_plan_08_repair", "op_plan_09_solution", "op_stm_05_lease_table"):
        told = io.StringIO()
        with contextlib.redirect_stdout(told):
            catalog.QUERIES[name](spark, sf).explain()
        assert "MapInArrow" in told.getvalue() and "FlatMapGroupsInPandas" not in told.getvalue(), name
