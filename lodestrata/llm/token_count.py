"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are encoded in batches of about equal UTF-8 bytes.  A long text is split at safe boundaries: at a
single space between two non-space characters (a stretch without one is encoded whole, as no other place is safe
for every vocabulary).  The encoder puts its word mark in front of every
part, which takes the place of that space, and no piece of the vocabulary has the word mark after
another character (checked when the encoder is loaded), so the counts of the parts add up to the
count of the whole.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; repeated rows are counted each by
itself; other columns are ignored; an empty table gives an empty result; a vocabulary that breaks
the condition above makes texts be encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernels as K

#: UTF-8 bytes of a batch, and code points from which on a text is split.
BATCH_BYTES, PART_CHARS = 256 << 10, 64 << 10
_encoders: dict = {}


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(model: str):
    """The loaded model and whether texts may be split at single spaces."""
    if model not in _encoders:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        dummy = sp.encode("a", out_type=str)[0].startswith("▁")
        _encoders[model] = sp, dummy and not any("▁" in p.lstrip("▁") for p in pieces)
    return _encoders[model]


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Parts of about ``size`` characters; the single space between two parts is left out."""
    parts, a, n = [], 0, len(text)
    while n - a > size:
        cut = a + size
        while True:
            cut = text.find(" ", cut, n - 1)
            if cut < 0 or text[cut - 1] not in " ▁" and text[cut + 1] not in " ▁":
                break
            cut += 1
        if cut < 0:
            break
        parts.append(text[a:cut])
        a = cut + 1
    parts.append(text[a:])
    return parts


def lengths(texts: list[str], model: str, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each text."""
    sp, splits = encoder(model)
    out = np.zeros(len(texts), np.int64)
    batch, owners, size = [], [], 0

    def flush():
        if batch:
            np.add.at(out, owners, [len(x) for x in sp.encode(batch, out_type=int, num_threads=1)])
            batch.clear(), owners.clear()

    for i, text in enumerate(texts):
        for part in safe_parts(text) if splits and len(text) > PART_CHARS else (text,):
            more = len(part) if part.isascii() else len(part.encode())
            if size + more > batch_bytes:
                flush()
                size = 0
            batch.append(part), owners.append(i)
            size += more
    flush()
    return out


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row; no shuffle."""
    model = model or tokenizer_path()

    def count(batches):
        for batch in batches:
            _, offs = K.utf8(batch.column(1))
            n = lengths([x or "" for x in batch.column(1).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
