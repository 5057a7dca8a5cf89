"""Operator 3: token ids as flat binary files with 64-bit document offsets, memory-mapped for reading.

Rows are dealt by ranges of (doc_id, text hash), so file order is doc_id order; every partition writes one set of
files, named by its attempt:

* ``.ids``  unsigned ids, 2 bytes each where the vocabulary allows it, else 4, little-endian, documents back to back;
* ``.off``  uint64 offsets in ids, one more than documents, counted from the partition's start;
* ``.doc``  int64 doc_id and ``.nul`` one byte that is 1 where the doc_id is null.

A partition's base is the prefix sum of the ids of the partitions before it; ``index.json`` holds all of them.

Rows: null text counts as empty and still gets the end id; a null doc_id sorts first; rows that share a doc_id follow
each other in the order of their text's hash; extra columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import store
from pixelloom.llm.library_tokens import encoder

FLUSH = 1 << 22


@dataclass(frozen=True)
class Part:
    name: str
    docs: int
    ids: int
    base: int
    first_doc: int


def _dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = 0) -> list[Part]:
    """Encode and write; the driver gets one row a partition, whatever the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        enc = encoder(tokenizer)
        kind = _dtype(enc.vocab_size)
        end = end_id.to_bytes(4, "little")
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, root = store.filesystem(out_dir)
        files: dict = {}
        counts = [0]
        for rows, texts in store.slices(batches):
            if not files:
                files = {k: fs.open_output_stream(f"{root}/{name}.{k}") for k in ("ids", "off", "doc", "nul")}
                files["off"].write(np.zeros(1, "<u8").tobytes())
            encoded = [enc.ids(t) + end for t in texts]
            files["ids"].write(np.frombuffer(b"".join(encoded), "<u4").astype(kind).tobytes())
            ends = counts[0] + np.cumsum([len(e) // 4 for e in encoded], dtype=np.uint64)
            counts[0] = int(ends[-1])
            files["off"].write(ends.astype("<u8").tobytes())
            key = rows.column(0)
            files["doc"].write(key.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            files["nul"].write(key.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            counts.append(rows.num_rows)
        for f in files.values():
            f.close()
        if files:
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [sum(counts[1:])], "ids": [counts[0]]})

    ordered = (
        store.texts(docs).withColumn("h", store.text_hash()).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    )
    rows = sorted(ordered.mapInArrow(run, "part long, name string, docs long, ids long").collect())
    parts, base, first = [], 0, 0
    for r in rows:
        parts.append(Part(r["name"], r["docs"], r["ids"], base, first))
        base, first = base + r["ids"], first + r["docs"]
    fs, root = store.filesystem(out_dir)
    with fs.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps({"dtype": _dtype(encoder(tokenizer).vocab_size), "ids": base, "docs": first, "parts": [vars(p) for p in parts]}).encode())
    return parts


class TokenFiles:
    """Reader: ids of the n-th document of the whole collection by memory map."""

    def __init__(self, out_dir: str):
        self.fs, self.root = store.filesystem(out_dir)
        with self.fs.open_input_stream(f"{self.root}/index.json") as f:
            index = json.loads(f.read())
        self.dtype, self.docs, self.ids = index["dtype"], index["docs"], index["ids"]
        self.parts = [Part(**p) for p in index["parts"]]
        self.firsts = np.array([p.first_doc for p in self.parts], dtype=np.int64)

    def map(self, part: Part, suffix: str, kind: str) -> np.ndarray:
        path = f"{self.root}/{part.name}.{suffix}"
        if self.fs.type_name == "local":
            return np.memmap(path, dtype=kind, mode="r")
        with self.fs.open_input_file(path) as f:  # a store that cannot be mapped is read
            return np.frombuffer(f.read(), dtype=kind)

    def __len__(self) -> int:
        return self.docs

    def __getitem__(self, n: int) -> np.ndarray:
        if not 0 <= n < self.docs:
            raise IndexError(n)
        part = self.parts[int(np.searchsorted(self.firsts, n, side="right")) - 1]
        off = self.map(part, "off", "<u8")
        a, b = (int(x) for x in off[n - part.first_doc : n - part.first_doc + 2])
        return self.map(part, "ids", self.dtype)[a:b]


def read(spark: SparkSession, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: a task maps the files of its partitions."""
    files = TokenFiles(out_dir)
    if not files.parts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TokenFiles(out_dir)
        for b in batches:
            for n in b.column(0).to_pylist():
                part = own.parts[n]
                ids = own.map(part, "ids", own.dtype) if part.ids else np.zeros(0, own.dtype)
                off = own.map(part, "off", "<u8").astype(np.int64)
                doc, nul = own.map(part, "doc", "<i8"), own.map(part, "nul", "u1")
                for s in range(0, part.docs, 10_000):
                    e = min(part.docs, s + 10_000)
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(off[s:e], off[s + 1 : e + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(doc[s:e]).astype(np.int64), mask=np.asarray(nul[s:e]).astype(bool)),
                            pa.array(part.base + off[s:e]),
                            pa.array(np.diff(off[s : e + 1])),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = len(files.parts)
    return spark.range(0, n, 1, n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
