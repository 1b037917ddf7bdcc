"""Token counts: whole texts through a public tokenizer, lengths only.

Texts are cut into pieces at safe boundaries: before a single space that
follows a non-blank and precedes a letter of any script, and for vocabularies
with pre-tokens (.json) also between a letter and the full-width or other
non-Latin punctuation that follows it, where no pre-token spans. Pieces are
dealt into encoder batches of about ``BATCH_BYTES`` bytes, and each text's
count is the sum over its pieces. Special strings inside texts are handled as
the library does by default; no tokens are added, truncated or padded.

Defined cases: null counts 0; equal texts in a batch are encoded once; a text
without a safe boundary is encoded as one piece; other columns stay, and the
new one's name gets underscores until it is free.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexeum.llm import common as C

BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 15
#: Sentence and clause signs of scripts that are written without spaces or with signs of their own.
SIGNS = "、。，！？；：「」『』（）【】《》〈〉…؟،؛।॥"
_SPACE = re.compile(r"(?<=\S) (?=[^\W\d_])")
_SIGN = re.compile(rf"(?<=\S) (?=[^\W\d_])|(?<=[^\W\d_])(?=[{SIGNS}])")
_loaded: dict = {}


def pieces(text: str, size: int = PIECE_CHARS, safe: re.Pattern = _SPACE) -> list[str]:
    """``text`` cut at safe boundaries into pieces of ``size`` characters or a little more."""
    out, at = [], 0
    while len(text) - at > size:
        m = safe.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def _encoder(name: str, content: bytes):
    """A function from texts to their token counts."""
    key = (name, len(content), hash(content))
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(content.decode())
            t.no_truncation()
            t.no_padding()
            encode = getattr(t, "encode_batch_fast", t.encode_batch)
            _loaded[key] = lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]
        elif name.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_proto=content)
            _loaded[key] = lambda texts: [len(x) for x in p.encode([t[1:] if i else t for t, i in texts], num_threads=1)]
        else:
            raise ValueError(f"no library is known for {name}")
    return _loaded[key]


def count_batch(texts: list[str], name: str, content: bytes) -> np.ndarray:
    """Token counts of ``texts``."""
    encode, plain = _encoder(name, content), name.endswith(".json")
    distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    totals = np.zeros(len(distinct), np.int64)
    batch, owner, size = [], [], 0

    def flush():
        nonlocal batch, owner, size
        if batch:
            np.add.at(totals, owner, encode(batch))
        batch, owner, size = [], [], 0

    for t, i in distinct.items():
        for k, p in enumerate(pieces(t, safe=_SIGN if plain else _SPACE)):
            batch.append(p if plain else (p, k))
            owner.append(i)
            size += len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass"))
            if size >= BATCH_BYTES:
                flush()
    flush()
    return totals[[distinct[t] for t in texts]] if texts else totals


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with a column of token counts; ``tokenizer`` is a file the driver reads (a vocabulary of a few MB)."""
    with open(tokenizer, "rb") as f:
        model = C.ready(docs.sparkSession).sparkContext.broadcast((os.path.basename(tokenizer), f.read()))

    def count(texts: pa.Array) -> pa.Array:
        _, off = C.utf8(texts)
        out = [count_batch([t or "" for t in texts.slice(a, b - a).to_pylist()], *model.value) for a, b in C.slices(off, 4 * BATCH_BYTES)]
        return pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())

    return docs.withColumn(C.fresh(docs, name), F.arrow_udf(count, "bigint").asNondeterministic()(F.col(text)))
