"""Token ids of documents as flat binary files, and reading them back through memory maps.

A folder holds for each part ``part-N``:

* ``part-N.bin``  the ids of all its documents on end, unsigned little-endian, 2 bytes each where the
  vocabulary allows it, else 4 (``width`` in the manifest);
* ``part-N.idx``  n_docs + 1 unsigned 64-bit offsets into it, counted in ids from the part's start;
* ``part-N.doc``  n_docs signed 64-bit document ids, then one byte each: 1, or 0 for a null id;

and ``manifest`` (Parquet: part, width, n_docs, n_tokens, base), where ``base`` is the number of ids in
all earlier parts, a prefix sum. Parts ascend by document id, and so do the documents in a part.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logweave.llm.stretches import IdStore, cut_texts, ragged, text_slices
from logweave.llm.words import give_back, worker_state
from logweave.session import with_conf, write_table

#: Kept stretches per Python worker (about 130 MB); what a full memory forgets costs time and changes no id.
MEMORY = 500_000
#: Bytes that the library encodes in one go.
RUN_BYTES = 1 << 17
#: Rows that a worker is sent at a time: the JVM and the worker hold their texts besides the one slice that is encoded.
BATCH_ROWS = "1000"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow knows: file, hdfs, s3, gs."""
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


class Encoder:
    """A byte-level BPE of the tokenizers library that encodes each distinct stretch of text once.

    New stretches go to the library on end, in runs: no token crosses from one into the next (``stretches``), and the bytes
    that each id stands for tell where one ends. A stretch that begins without a space or ends with a blank, one
    with a special token, and a run whose ids do not end where its stretches do, are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        assert not any(re.search(rb"\s", s) for s in self.special), "added tokens with blanks are not supported"
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # a character of an entry stands for one byte
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max([self.size - 1, *vocab.values()]) + 1, np.int64)
        for entry, i in vocab.items():
            self.n_bytes[i] = len(entry)
        self.store = IdStore(self._encode, MEMORY)

    def _singly(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [self.tokenizer.encode(x.decode(), add_special_tokens=False).ids for x in stretches]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.int64, int(size.sum())), size

    def _run(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all on end, ids of each)."""
        whole = b"".join(stretches)
        if any(s in whole for s in self.special):
            return self._singly(stretches)
        ids = np.array(self.tokenizer.encode_batch_fast([whole.decode()], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(self.n_bytes[ids])
        stops = np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches)))
        last = np.searchsorted(ends, stops)
        if ends[-1] != stops[-1] or (ends[last] != stops).any():
            return self._singly(stretches)
        return ids, np.diff(last, prepend=-1)

    def _encode(self, stretches: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray]]:
        follows = np.array([x[0] == 32 and not x[-1:].isspace() for x in stretches])
        order = np.argsort(~follows, kind="stable")
        filled = np.cumsum([len(stretches[k]) for k in order.tolist()]) // RUN_BYTES
        cuts = np.flatnonzero(np.diff(filled)) + 1
        n = int(follows.sum())
        done = [self._run([stretches[k] for k in run.tolist()]) for run in np.split(order[:n], cuts[cuts < n]) if len(run)]
        if n < len(order):
            done.append(self._singly([stretches[k] for k in order[n:].tolist()]))
        flat, size = (np.concatenate(x) for x in zip(*done, strict=True))
        place = np.argsort(order)
        first = np.cumsum(size) - size
        return ((flat[ragged(first[place], size[place])], size[place]),)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, ids of each text), for whole texts of any length."""
        return self.store.ids(cut_texts(texts))


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", parts: int | None = None
) -> DataFrame:
    """Write the whole ``text`` of every row and ``end_id`` after it; returns the manifest.

    Rows ascend by ``doc_id`` (nulls first), equal ids by their text. ``folder`` is new and lies in a
    store that executors and driver share. A null or empty text is ``end_id`` alone; a table without
    rows gives an empty manifest. Other columns are left out. Parts are written under a name of the
    attempt and renamed when whole, so that a lost executor leaves no half part.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("token_files")
        if tokenizer not in state:
            state[tokenizer] = Encoder(tokenizer)
        encoder = state[tokenizer]
        kind = "<u2" if max(encoder.size - 1, end_id) < 1 << 16 else "<u4"
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        trial = f"{root}/.try-{uuid.uuid4().hex}"
        ids, valid, lengths = [], [], []
        with store.open_output_stream(f"{trial}.bin") as out:
            for batch in batches:
                column = batch.column(0)
                ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                valid.append(column.is_valid().to_numpy(zero_copy_only=False).astype("u1"))
                for _, texts in text_slices(batch, 1):
                    flat, counts = encoder.ids(texts)
                    out.write(np.insert(flat, np.cumsum(counts), end_id).astype(kind).tobytes())
                    lengths += (counts + 1).tolist()
        if lengths:
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
            for kind_, data in (("idx", offsets.tobytes()), ("doc", np.concatenate(ids).tobytes() + np.concatenate(valid).tobytes())):
                with store.open_output_stream(f"{trial}.{kind_}") as out:
                    out.write(data)
            for kind_ in ("bin", "idx", "doc"):
                whole = f"{root}/part-{part:05d}.{kind_}"
                if store.get_file_info(whole).type != pafs.FileType.NotFound:
                    store.delete_file(whole)  # of an earlier attempt, with the same content
                store.move(f"{trial}.{kind_}", whole)
            yield pa.RecordBatch.from_pydict({"part": [part], "width": [int(kind[2])], "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])]})
        else:
            store.delete_file(f"{trial}.bin")
        give_back()

    manifest = f"{folder}/manifest"
    written = rows.mapInArrow(write, "part long, width long, n_docs long, n_tokens long")
    with with_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS):
        write_table(written, f"{folder}/counts")
    counts = spark.read.schema(written.schema).parquet(f"{folder}/counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    counts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(manifest)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part long, width long, n_docs long, n_tokens long, base long").parquet(f"{folder}/manifest")


def _mapped(store: pafs.FileSystem, path: str) -> pa.Buffer:
    if isinstance(store, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with store.open_input_file(path) as file:
        return file.read_buffer()


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers), and with ``with_ids`` the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    manifest = read_manifest(spark, folder)
    # a part is one row: rows go one to a task
    dealt = manifest.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{root}/part-{row['part']:05d}"
                n = row["n_docs"]
                flat = np.frombuffer(_mapped(store, f"{stem}.bin"), f"<u{row['width']}")
                offsets = np.frombuffer(_mapped(store, f"{stem}.idx"), "<u8").astype(np.int64)
                docs = _mapped(store, f"{stem}.doc")
                ids, valid = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, "u1", n, 8 * n)
                for a in range(0, n, 4096):
                    b = min(n, a + 4096)
                    spans = [flat[offsets[i] : offsets[i + 1]] for i in range(a, b)]
                    out = [
                        pa.array(ids[a:b], pa.int64(), mask=valid[a:b] == 0),
                        pa.array(offsets[a:b] + row["base"], pa.int64()),
                        pa.array(np.diff(offsets[a : b + 1]), pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in spans], pa.int64()),
                    ]
                    if with_ids:
                        out.append(pa.array([x.tolist() for x in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return dealt.mapInArrow(read, schema)
