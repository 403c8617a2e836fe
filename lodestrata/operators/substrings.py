"""Which keys occur inside which texts: a substring has no value to join on, so keys are met by an automaton.

Keys are counted and go to the tasks in blocks of a bounded number; a block is one automaton, and a task runs it over its texts in Arrow
batches, so a text is read once for each block, whatever the number of keys that it holds.  There is no bound on the number of
blocks, and no row for a character.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of one automaton.
BLOCK = 100_000


def _block(texts: DataFrame, keys: list[str], pairs: bool) -> DataFrame:
    names = ["text", "key"] if pairs else ["key"]

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k in keys:
            if k:
                automaton.add_word(k, k)
        automaton.make_automaton()
        empty = [k for k in keys if not k]  # inside every text
        told: set[str] = set()
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                if text is None:
                    continue
                met = {k for _, k in automaton.iter(text)} if len(automaton) else set()
                met.update(empty)
                if pairs:
                    found += [(text, k) for k in sorted(met)]
                elif fresh := met - told:
                    told |= fresh
                    found += [(k,) for k in sorted(fresh)]
            columns = list(zip(*found)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)

    return texts.select("text").mapInArrow(run, ", ".join(f"{c} string" for c in names))


def _in_blocks(texts: DataFrame, keys: DataFrame, pairs: bool, block: int) -> DataFrame:
    keys = keys.select("key").where("key is not null").distinct()
    n = keys.count()
    count = max(1, -(-n // block))
    out = None
    for b in range(count):
        part = keys if count == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(count)) == b)
        found = _block(texts, [r["key"] for r in part.toLocalIterator()], pairs)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def keys_within(texts: DataFrame, keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key) of the keys (key) that are part of some text (text).  A task names a key once."""
    return _in_blocks(texts, keys, False, block)


def pairs_within(texts: DataFrame, keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """(text, key) of each text and the keys that are part of it; repeated texts are asked once."""
    return _in_blocks(texts.select("text").distinct(), keys, True, block)
