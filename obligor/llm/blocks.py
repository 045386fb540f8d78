"""Look up corpus-wide facts about terms without moving a row per term and document.

Documents are packed into blocks. A block keeps, for each document, the numbers of its
terms and how often each occurs, and lists each distinct term once, dealt into buckets by
a hash. Buckets meet across blocks in one shuffle, so a term is judged once, by one
task, whatever number of rows hold it; one value per (block, term) goes back; and block
and values meet in a second shuffle, where each document sums over its own terms.

What is shuffled is the distinct terms of a block and the packed counts, not the texts. A
term of every document is one entry per block, so no key is hot. Memory follows
``BLOCK_TERMS`` and the number of buckets, which is ``spark.sql.shuffle.partitions``: size
that to the data as for any other shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obligor.llm.words import texts_of
from obligor.session import pin

#: Distinct terms after which a block is closed.
BLOCK_TERMS = 400_000

_PACKED = (
    "block long, bucket int, doc_ids array<long>, facts binary, ends binary, numbers binary,"
    " counts binary, terms binary, lengths binary, weights binary"
)
_NAMES = [part.split()[0] for part in _PACKED.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 7]

#: Facts of a document, its terms, and the weight of its terms in the corpus sums.
Document = tuple[list[int], list[bytes], int]


def planes(values: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers of ``width`` bytes, all low bytes first: small numbers compress well so."""
    return np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()


def unplaned(data: bytes, width: int = 4) -> np.ndarray:
    rows = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T)
    return rows.view(f"<u{width}").ravel().astype(np.int64)


class _Block:
    """Documents gathered until the block is closed."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.doc_ids: list[int | None] = []
        self.facts: list[list[int]] = []
        self.sizes: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.weights: list[int] = []

    def add(self, doc_id: int | None, document: Document) -> None:
        facts, terms, weight = document
        counted = Counter(terms)
        n = len(counted)
        self.doc_ids.append(doc_id)
        self.facts.append(facts)
        self.sizes.append(n)
        self.numbers.append(np.fromiter(map(self.number.__getitem__, counted), np.uint32, n))
        self.counts.append(np.fromiter(counted.values(), np.uint32, n))
        self.weights.append(weight)

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        terms = list(self.number)
        numbers = np.concatenate([*self.numbers, np.empty(0, np.uint32)]).astype(np.int64)
        counts = np.concatenate([*self.counts, np.empty(0, np.uint32)])
        weights = np.bincount(
            numbers,
            counts * np.repeat(np.array(self.weights, np.float64), self.sizes),
            minlength=len(terms),
        )
        bucket = np.fromiter((zlib.crc32(t) for t in terms), np.int64, len(terms)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        facts = np.array(self.facts, "<i8").tobytes()
        yield (
            block, -1, self.doc_ids, facts, planes(np.cumsum(self.sizes)),
            planes(place[numbers]), planes(counts), None, None, None,
        )
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts):
            if part.size:
                own = [terms[i] for i in part.tolist()]
                yield (
                    block, int(bucket[part[0]]), None, None, None, None, None, b"".join(own),
                    planes(np.array([len(t) for t in own])), planes(weights[part], 8),
                )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def pack(
    df: DataFrame,
    reader: Callable[[], Callable[[list[int | None], list[bytes]], list[Document]]],
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Blocks of (doc_id, text) rows, written to the shared folder.

    ``reader`` makes, once per task, the function that cuts a batch of texts into terms.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        read, block, made = reader(), _Block(), 0
        first = TaskContext.get().partitionId() << 32

        def close() -> Iterator[pa.RecordBatch]:
            rows = list(block.rows(first + made, buckets))
            for start in range(0, len(rows), 64):
                yield _batch(rows[start : start + 64])

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))
            for doc_id, document in zip(doc_ids, read(doc_ids, texts), strict=True):
                block.add(doc_id, document)
                if len(block.number) > block_terms:
                    yield from close()
                    block, made = _Block(), made + 1
        if block.doc_ids:
            yield from close()

    return pin(df.select("doc_id", "text").mapInArrow(run, _PACKED), "blocks")


def judge(
    packed: DataFrame, value: Callable[[list[bytes], np.ndarray], np.ndarray]
) -> DataFrame:
    """One value for each term of each block: (block, bucket, values, used, mass).

    ``value`` sees every distinct term of a bucket once, with its weight in the corpus.
    ``used`` counts the bucket's distinct terms with a weight, ``mass`` sums the weights.
    """

    def run(table: pa.Table) -> pa.Table:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        places = []
        blobs = zip(
            table.column("terms").to_pylist(), table.column("lengths").to_pylist(), strict=True
        )
        for blob, lengths in blobs:
            ends = np.cumsum(unplaned(lengths)).tolist()
            starts = [0, *ends[:-1]]
            places.append(
                np.fromiter(
                    (number[blob[a:b]] for a, b in zip(starts, ends, strict=True)),
                    np.int64,
                    len(ends),
                )
            )
        total = np.zeros(len(number))
        for place, weight in zip(places, table.column("weights").to_pylist(), strict=True):
            total[place] += unplaned(weight, 8)
        values = value(list(number), total)
        rest = [0] * (table.num_rows - 1)
        return pa.table(
            {
                "block": table.column("block").cast(pa.int64()),
                "bucket": table.column("bucket").cast(pa.int32()),
                "values": pa.array([planes(values[place], 8) for place in places], pa.binary()),
                "used": pa.array([int((total > 0).sum()), *rest], pa.int64()),
                "mass": pa.array([int(total.sum()), *rest], pa.int64()),
            }
        )

    terms = packed.where("bucket >= 0").select("block", "bucket", "terms", "lengths", "weights")
    return terms.groupBy("bucket").applyInArrow(
        run, "block long, bucket int, values binary, used long, mass long"
    )


def summed(
    packed: DataFrame,
    judged: DataFrame,
    result: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]],
    schema: str,
) -> DataFrame:
    """Rows of ``result(facts, document, counts, values)`` for every document.

    ``document``, ``counts`` and ``values`` have one entry per (document, distinct term);
    ``facts`` one row per document. ``schema`` names the columns after doc_id.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left.to_pylist()[0]
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("values").to_pylist(), strict=True))
        values = np.concatenate([*(unplaned(v, 8) for _, v in parts), np.empty(0, np.int64)])
        ends = unplaned(docs["ends"])
        sizes = np.diff(ends, prepend=0)
        facts = np.frombuffer(docs["facts"], "<i8").reshape(ends.size, -1)
        columns = result(
            facts,
            np.repeat(np.arange(ends.size), sizes),
            unplaned(docs["counts"]),
            values[unplaned(docs["numbers"])],
        )
        return pa.table(
            {"doc_id": pa.array(docs["doc_ids"], pa.int64())} | {n: pa.array(columns[n]) for n in names}
        )

    docs = packed.where("bucket = -1").select(
        "block", "doc_ids", "facts", "ends", "numbers", "counts"
    )
    return (
        docs.groupBy("block")
        .cogroup(judged.select("block", "bucket", "values").groupBy("block"))
        .applyInArrow(run, f"doc_id long, {schema}")
    )
