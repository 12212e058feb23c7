"""Content-addressed token store: rolling-hash chunks, unique chunks stored once, recipes and Merkle manifests.

Layout below a root in the shared folder:

* ``packs/*.pack``: compressed chunks one after the other;
* ``index``: Parquet (digest, pack, offset, size), one row per distinct chunk;
* ``recipes``: Parquet, files in ascending order of id: doc_id, start, n_tokens, digests, leaf, part, seq;
* ``manifest``: Parquet (part, n_docs, root): the Merkle root over the leaves of each recipe file.

Writing moves no payload between tasks: each task packs its own distinct chunks, a join of digests alone picks
one place for each chunk, and the packs are copied without what another pack holds. Reading gathers chunk
places by document, merges neighbouring ranges of a pack into one read, and checks every digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, open_store, release, remove, slices, slots, small_batches, stored
from .tokenizing import encoder, vocabulary

END_ID = 2
#: Tokens of a chunk: none is cut below LEAST or above MOST; on average about LEAST + (1 << CUT_BITS).
LEAST, MOST, CUT_BITS = 256, 8192, 9
DIGEST = 16
_U = np.uint64


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def _cut_points(ids: np.ndarray) -> np.ndarray:
    """Positions behind which the hash of the last 16 ids asks for a cut."""
    h = (ids.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    span, base = 1, 0xBF58476D1CE4E5B9
    while span < 16:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] * _U(pow(base, span, 1 << 64))
        h, span = h + shifted, span * 2
    return np.flatnonzero(h >> _U(64 - CUT_BITS) == 0) + 1


def chunks(ids: np.ndarray, cuts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Content-defined (start, end) of the chunks of one document's ids."""
    out, start = [], 0
    for cut in (_cut_points(ids) if cuts is None else cuts).tolist():
        while cut - start > MOST:
            out.append((start, start + MOST))
            start += MOST
        if cut - start >= LEAST:
            out.append((start, cut))
            start = cut
    while len(ids) - start > MOST:
        out.append((start, start + MOST))
        start += MOST
    if start < len(ids):
        out.append((start, len(ids)))
    return out


STAGED = "n_tokens long, pack string, digests array<binary>, offsets array<long>, sizes array<int>"


def _pack(path: str, end_id: int, folder: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = encoder(path), zstandard.ZstdCompressor(level=1)
        name, sink, at, seen = "", None, 0, {}
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            if sink is None:
                files, where = open_store(folder)
                files.create_dir(where, recursive=True)
                name = f"{uuid.uuid4().hex}.pack"
                sink = files.open_output_stream(f"{where}/{name}")
            ids = [np.append(x, encode.dtype.type(end_id)) for x in encode.encode(batch.column(1))]
            ends = np.cumsum([len(x) for x in ids])
            cuts = _cut_points(np.concatenate(ids)) if ids else np.empty(0, np.int64)
            edges = np.searchsorted(cuts, np.append(0, ends), side="right")
            for i, own in enumerate(ids):
                begin = int(ends[i]) - len(own)
                digests, offsets, sizes = [], [], []
                for a, b in chunks(own, cuts[edges[i] : edges[i + 1]] - begin):
                    raw = own[a:b].tobytes()
                    digest = _digest(raw)
                    if digest not in seen:
                        data = press.compress(raw)
                        sink.write(data)
                        seen[digest] = (at, len(data))
                        at += len(data)
                    digests.append(digest)
                    offsets.append(seen[digest][0])
                    sizes.append(seen[digest][1])
                rows.append((len(own), name, digests, offsets, sizes))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "pack", "digests", "offsets", "sizes"])
        if sink is not None:
            sink.close()

    return pack


def _compact(source: str, target: str):
    """Copy the wanted chunks of each pack to a pack of its own."""

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = open_store(source)
        _, goal = open_store(target)
        files.create_dir(goal, recursive=True)
        for batch in batches:
            for pack, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wanted.sort(key=lambda w: w["offset"])
                name, at, rows = f"{uuid.uuid4().hex}.pack", 0, []
                with files.open_input_file(f"{where}/{pack}") as data, files.open_output_stream(f"{goal}/{name}") as sink:
                    for group in _ranges([(w["offset"], w["size"]) for w in wanted]):
                        begin, end = group[0]
                        block = data.read_at(end - begin, begin)
                        for i in group[1]:
                            w = wanted[i]
                            sink.write(block[w["offset"] - begin : w["offset"] - begin + w["size"]])
                            rows.append((w["digest"], name, at, w["size"]))
                            at += w["size"]
                columns = zip(*rows) if rows else ([], [], [], [])
                kinds = (pa.binary(), pa.string(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "pack", "offset", "size"])

    return compact


def _ranges(places: list[tuple[int, int]], gap: int = 1 << 16, most: int = 1 << 23) -> Iterator[tuple[tuple[int, int], list[int]]]:
    """Merge sorted (offset, size) places with small gaps into ranges to read: ((begin, end), their numbers)."""
    begin = end = 0
    own: list[int] = []
    for i, (offset, size) in enumerate(places):
        if own and (offset > end + gap or offset + size - begin > most):
            yield (begin, end), own
            own = []
        if not own:
            begin = end = offset
        end = max(end, offset + size)
        own.append(i)
    if own:
        yield (begin, end), own


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merkle root of the leaves of each part; rows come ordered by (part, seq), the stack is logarithmic."""
    part, n, stack = None, 0, []

    def closed():
        node = stack[-1][1]
        for _, left in reversed(stack[:-1]):
            node = hashlib.sha256(left + node).digest()
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [n], "root": [node.hex()]})

    for batch in batches:
        for p, leaf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p != part and stack:
                yield closed()
                stack, n = [], 0
            part, n, node, height = p, n + 1, bytes.fromhex(leaf), 0
            while stack and stack[-1][0] == height:
                node, height = hashlib.sha256(stack.pop()[1] + node).digest(), height + 1
            stack.append((height, node))
    if stack:
        yield closed()


def _leaf():
    return F.sha2(F.concat(F.encode(F.col("n_tokens").cast("string"), "UTF-8"), F.col("recipe")), 256)


def part_roots(recipes: DataFrame) -> DataFrame:
    rows = recipes.select("part", "seq", "leaf").repartition(slots(recipes.sparkSession), "part").sortWithinPartitions("part", "seq")
    return rows.select("part", "leaf").mapInArrow(_roots, "part int, n_docs long, root string")


@dataclass
class TokenStore:
    """A written store: its root folder and the tables that lie there."""

    root: str
    vocabulary_path: str
    recipes: DataFrame
    index: DataFrame
    manifest: DataFrame


def _part(spark: SparkSession, df: DataFrame, root: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return spark.read.schema(df.schema).parquet(f"{root}/{name}")


def write_store(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str | None = None,
    end_id: int = END_ID,
    root: str | None = None,
) -> TokenStore:
    """Encode whole texts, append ``end_id`` to each and write the store.

    Null and empty texts are the end id alone. Rows are ordered by id, null first; rows that repeat an id stand
    together in no stated order and each keeps its own recipe. An empty table gives a store without packs.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path, root = vocabulary_path or vocabulary(), root or new_path(spark, "token_store")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    staged = base.mapInArrow(_pack(path, end_id, f"{root}/staging"), f"doc_id {kind}, {STAGED}")
    staged = stored(staged, "staged")
    where = F.explode(F.arrays_zip("digests", "offsets", "sizes")).alias("c")
    places = staged.select("pack", where).select(F.col("c.digests").alias("digest"), F.struct("pack", F.col("c.offsets").alias("offset"), F.col("c.sizes").alias("size")).alias("place"))
    kept = places.groupBy("digest").agg(F.min("place").alias("place"))
    by_pack = kept.groupBy(F.col("place.pack").alias("pack")).agg(F.collect_list(F.struct("digest", "place.offset", "place.size")).alias("wanted"))
    copied = by_pack.mapInArrow(_compact(f"{root}/staging", f"{root}/packs"), "digest binary, pack string, offset long, size int")
    index = _part(spark, copied, root, "index")
    remove(spark, f"{root}/staging")
    slim = staged.select("doc_id", "n_tokens", F.array_join(F.transform("digests", F.hex), "").alias("hex"))
    slim = slim.select("doc_id", "n_tokens", F.unhex("hex").alias("recipe")).withColumn("leaf", _leaf())
    ranged = slim.repartitionByRange(slots(spark), F.col("doc_id").asc_nulls_first(), "leaf")
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "leaf")
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    recipes = ranged.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    recipes = _part(spark, recipes.select("doc_id", "start", "n_tokens", "recipe", "leaf", "part", "seq"), root, "recipes")
    manifest = _part(spark, part_roots(recipes), root, "manifest")
    release(spark)
    return TokenStore(root, path, recipes, index, manifest)


def _gather(folder: str, path: str, id_type: pa.DataType, with_ids: bool):
    """Chunk places ordered by (part, seq, at) to the ids of each document; a document may span batches."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = open_store(folder)
        opened: OrderedDict[str, object] = OrderedDict()
        unpress, dtype = zstandard.ZstdDecompressor(), encoder(path).dtype
        current, parts = None, []

        def read(batch) -> list[bytes]:
            packs, offsets, sizes = (batch.column(c).to_pylist() for c in ("pack", "offset", "size"))
            digests, out, by_pack = batch.column("digest").to_pylist(), [b""] * len(batch), {}
            for i, pack in enumerate(packs):
                by_pack.setdefault(pack, []).append(i)
            for pack, rows in by_pack.items():
                rows.sort(key=offsets.__getitem__)
                if pack not in opened:
                    opened[pack] = files.open_input_file(f"{where}/{pack}")
                    if len(opened) > 64:
                        opened.popitem(last=False)[1].close()
                opened.move_to_end(pack)
                for (begin, end), own in _ranges([(offsets[i], sizes[i]) for i in rows]):
                    block = opened[pack].read_at(end - begin, begin)
                    for i in (rows[k] for k in own):
                        raw = unpress.decompress(block[offsets[i] - begin : offsets[i] - begin + sizes[i]], max_output_size=MOST * dtype.itemsize)
                        if _digest(raw) != digests[i]:
                            raise ValueError(f"chunk {digests[i].hex()} in {pack} is damaged")
                        out[i] = raw
            return out

        def row():
            ids = np.frombuffer(b"".join(parts), dtype)
            if len(ids) != current[3]:
                raise ValueError(f"document {current[1]}: {len(ids)} ids, recipe has {current[3]}")
            return current[1], current[2], ids

        def made(rows):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], id_type),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()),
                    pa.array([r[2].astype(np.int32) if with_ids else None for r in rows], pa.list_(pa.int32())),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
            )

        for batch in batches:
            rows, data = [], read(batch)
            for key, raw in zip(zip(*(batch.column(c).to_pylist() for c in ("seq", "doc_id", "start", "n_tokens"))), data, strict=True):
                if current is not None and key[0] != current[0]:
                    rows.append(row())
                    parts = []
                current = key
                parts.append(raw)
            if rows:
                yield made(rows)
        if current is not None:
            yield made([row()])

    return gather


def read_store(store: TokenStore, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document from the files.

    Digests, leaves and manifest are checked. ids_crc32 is over the ids as little-endian unsigned 32-bit
    integers; ids are null unless ``with_ids``.
    """
    spark = store.recipes.sparkSession
    wrong = store.recipes.filter(F.col("leaf") != _leaf()).limit(1).count()
    differ = part_roots(store.recipes).exceptAll(store.manifest).limit(1).count()
    if wrong or differ:
        raise ValueError("recipes don't match their leaves or the manifest")
    n = (F.octet_length("recipe") / DIGEST).cast("int")
    digests = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("recipe"), i * DIGEST + 1, F.lit(DIGEST)))
    asked = store.recipes.select("doc_id", "start", "n_tokens", "part", "seq", F.posexplode(digests).alias("at", "digest"))
    placed = asked.join(store.index, "digest")
    ranged = placed.repartitionByRange(slots(spark), "seq").sortWithinPartitions("seq", "at")
    kind = store.recipes.schema["doc_id"].dataType
    gather = _gather(f"{store.root}/packs", store.vocabulary_path, _arrow(kind), with_ids)
    return ranged.mapInArrow(gather, f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long, ids array<int>")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
