"""What tasks leave in their Python process."""

import pyarrow as pa

from mapshelf.llm import tokens
from mapshelf.llm.common import tidy


def test_a_task_begins_without_the_memories_of_others():
    first = tokens.encoder(tokens.default_path())
    first.encode(["some words to remember"])
    seen = []

    def run(batches):
        seen.append(tokens.encoder.cache_info().currsize)
        yield from batches

    rows = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    assert list(tidy(run)(iter([rows]))) == [rows]
    assert seen == [0] and tokens.encoder(tokens.default_path()) is not first
