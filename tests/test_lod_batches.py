import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quadfield.operators import lod
from quadfield.sources import generators as gen


def test_vertices_at_mixed_levels(spark):
    """Levels and orders mixed in a batch, with batches of one element and of many."""
    m = gen.box(spark, 5, 4, 4, case="a").unionByName(gen.box(spark, 3, 2, 7, case="b"))
    m = gen.analytic_field(m, "q", lambda x, y: x * x * y + 3 * y).withColumn("m", F.when(F.col("elem") != 4, F.col("elem").cast("int") % 5 + 2))
    want = {(r.case, r.elem): r.m for r in m.select("case", "elem", "m").collect() if r.m}
    for size in (1, 4000, 8 << 20):
        rows = lod.lod_vertices(m.coalesce(1), ["q"], size).collect()
        got = {}
        for r in rows:
            got.setdefault((r.case, r.elem), []).append(r)
        assert set(got) == set(want)
        for k, own in got.items():
            n = want[k] + 1
            assert sorted(r.a for r in own) == list(range(n * n)) and all(r.m == want[k] for r in own)
            assert all(r.q == pytest.approx(r.x * r.x * r.y + 3 * r.y, abs=1e-11) for r in own)
            own.sort(key=lambda r: r.a)
            assert own[1].x > own[0].x and own[n].y > own[0].y and own[1].y == pytest.approx(own[0].y)


WORKER = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, sys.argv[1])
from quadfield.operators import lod

held = {}
class Frame:  # the kernel alone, fed with one batch of 10,000 elements
    def __init__(self, schema): self.schema = schema
    def where(self, *_): return self
    def select(self, *_): return self
    def mapInArrow(self, run, schema): held['run'] = run; return self

from pyspark.sql import types as T
kinds = T.StructType([T.StructField('case', T.StringType()), T.StructField('elem', T.LongType()), T.StructField('m', T.IntegerType()), *[T.StructField(k, T.ArrayType(T.DoubleType())) for k in ('x', 'y', 'q')]])
frame = Frame(kinds)
frame.columns = kinds.names
lod.lod_vertices(frame, ['q'])
n = 10_000
lists = lambda: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(np.random.default_rng(0).random(n * 64)))
batch = pa.RecordBatch.from_arrays([pa.array(['c'] * n), pa.array(np.arange(n)), pa.array(np.full(n, 64, np.int32)), lists(), lists(), lists()], names=kinds.names)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = largest = 0
for b in held['run'](iter([batch])):
    rows += b.num_rows
    largest = max(largest, b.nbytes)
print(rows, largest, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_of_the_kernel():
    """10,000 elements at level 64 are 42 million vertices; the worker needs less than 150 MB beyond its input."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", WORKER, root], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    rows, largest, grown = map(int, out.stdout.split())
    assert rows == 10_000 * 65 * 65 and largest <= 10 << 20 and grown < 150
