"""Packing by power-of-two decomposition: a document's ids are cut at the binary digits of their number.

A document of t ids (its end mark included) gives t // 2048 pieces of 2048 ids and one for each binary digit of the
rest, from the largest down. Every piece is a sequence by itself and falls into the bucket of its length, so batches of
equal length need no padding and no sequence crosses documents.

Defined cases. Null or empty text: the end mark alone, one piece of length 1. Null doc_id: kept as null. Rows that share
a doc_id are packed each by itself. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encoded words that a worker keeps (all are forgotten when there are more), the longest of them, and new ones a call.
WORDS_KEPT, LONGEST_KEPT, JOINED = 600_000, 48, 2000
#: Characters that are encoded at a time.
LONG = 1 << 20
#: Marks behind letters and before white space: a token run of their own. Special tokens begin with ``SPECIAL``.
MARKS = re.compile("([.,;:!?$#%&*|])(?<=[a-z\u00df-\u00f6\u00f8-\u00ff].)([.,;:!?$#%&*|]*)(?=[ \\n]|$)")
#: Byte-level spelling: printable bytes stand for themselves, the others for letters from U+0100 on.
SPELT = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 512)))
SPECIAL = "<|"

#: What a vocabulary's normaliser and splitter must be for the cuts of :class:`Encoder` to hold (fixed values).
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_encoders: dict[str, Encoder] = {}


def long_cut(text: str) -> Iterator[str]:
    """Parts of about ``LONG`` characters at most that end before a blank; one without blanks is longer."""
    at = 0
    while len(text) - at > LONG:
        end = text.rfind(" ", at + 1, at + LONG)
        end = end if end > at else text.find(" ", at + LONG)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class Encoder:
    """Ids as little-endian 32-bit bytes.

    A vocabulary with other rules than ``NORMALISER`` and ``SPLITTER`` encodes whole texts. With these, no token crosses white space or the end of a run of letters, and case doesn't matter to it. So a
    text is cut there, in lower case where that is one letter for one, and every word is encoded once: new runs of letters
    by the tokenizer's model, the others by the whole tokenizer together, told apart by a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules, added = json.loads(self.tokenizer.to_str()), self.tokenizer.get_added_tokens_decoder()
        self.cuts = rules["normalizer"] == NORMALISER and rules["pre_tokenizer"] == SPLITTER and not rules["post_processor"] and bool(added) and all(t.content.startswith(SPECIAL) for t in added.values())
        self.mark, self.between = min((i, t.content) for i, t in added.items()) if self.cuts else (None, None)
        self.words: dict[str, bytes] = {"": b""}

    def cut(self, text: str) -> list[str]:
        if SPECIAL not in text:
            try:
                text.encode("latin-1")
                text = MARKS.sub(r" \1\2", text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if any(len(t) > LONG for t in texts):
            return [b"".join(x for part in long_cut(t) for x in self.encode([part])) if len(t) > LONG else self.encode([t])[0] for t in texts]
        split = [self.cut(t) for t in texts]
        if len(self.words) > WORDS_KEPT:
            self.words = {"": b""}
        fresh = list(set().union(*split) - self.words.keys())
        alone, other, run = [], [], self.tokenizer.model.tokenize
        for w in fresh:
            if w.isalpha() and w.islower() and max(w) < "\u0100" or not w.strip(".,;:!?$#%&*|"):
                # one run of small letters or of marks: the model's own input, once its bytes are spelt out
                self.words[w] = np.array([t.id for t in run(w if w.isascii() else w.encode().decode("latin-1").translate(SPELT))], "<u4").tobytes()
            else:
                (alone if SPECIAL in w else other).append(w)
        for at in range(0, len(other), JOINED):
            some = other[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(some)], add_special_tokens=False)[0].ids, "<u4")
            body, ends = ids.tobytes(), np.append(np.flatnonzero(ids == self.mark), len(ids)) * 4
            starts = np.append(0, ends[:-1] + 4)
            self.words.update((w, body[i:j]) for w, i, j in zip(some, starts.tolist(), ends.tolist(), strict=True))
        self.words.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in alone)
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > LONGEST_KEPT:
                del self.words[w]
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, longest: int = 2048) -> list[int]:
    """Piece lengths of ``n`` ids, the longest first; ``longest`` is a power of two."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in reversed(range(longest.bit_length() - 1)) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end: int = 1, ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if asked for, its ids.

    ``tokenizer`` is the path of a vocabulary file that the executors can read.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, body in zip(part.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                    body, start = body + mark, 0
                    for n in cuts(total := len(body) // 4, longest):
                        piece = body[4 * start : 4 * (start + n)]
                        rows["doc_id"].append(doc)
                        rows["start"].append(start)
                        rows["length"].append(n)
                        rows["ids_crc32"].append(zlib.crc32(piece))
                        rows["doc_tokens"].append(total)
                        if ids:
                            rows["ids"].append(np.frombuffer(piece, "<i4"))
                        start += n
                columns = [pa.array(v, pa.int64()) for k, v in rows.items() if k != "ids"]
                yield pa.record_batch(columns + [pa.array(rows["ids"], pa.list_(pa.int32()))] * ids, [k for k in rows if ids or k != "ids"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = slim.mapInArrow(run, schema).withColumn("sequence_id", F.monotonically_increasing_id())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"), *["ids"] * ids)


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), ids=False)
