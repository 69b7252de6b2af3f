import tracemalloc

import pyarrow as pa
import pytest

from quillspark.llm import near, work
from quillspark.llm.features import features


def steps():
    """Work on a slice of texts, as the tasks of the pipeline do it."""
    powers = work.Powers(0x9E3779B97F4A7C15)
    return {
        "features": lambda b: features(*work.raw_bytes(b.column("text"))),
        "signatures": lambda b: near.band_keys(*near.shingles(b.column("text"), powers)),
    }


@pytest.mark.parametrize("name", ["features", "signatures"])
def test_what_a_worker_holds_beside_a_full_batch(name):
    """Two workers of an executor share what its heap leaves; a batch of 8 MB of text is worked off in slices."""
    step = steps()[name]
    text = " ".join(f"word{i % 977}" for i in range(300))
    batch = pa.record_batch([pa.array([text] * ((8 << 20) // len(text)))], ["text"])
    step(batch.slice(0, 1))
    tracemalloc.start()
    try:
        for b in work.slices([batch]):
            step(b)
        assert tracemalloc.get_traced_memory()[1] < 36 << 20
    finally:
        tracemalloc.stop()


def test_batches_that_go_to_python_are_small(spark):
    """Both sides hold a batch several times over, for each task."""
    work.prepare(spark)
    rows = spark.range(4000).selectExpr("repeat('x', 4000) AS text").coalesce(1)
    sizes = rows.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) > 16_000_000 and max(r["n"] for r in sizes) < 4 << 20
