"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Every text is cut into pre-tokens. A block of documents lists each of its distinct pre-tokens once, and the place of every
pre-token as a number into that list. The listed words are shuffled by a hash of the word, so that equal words of all
blocks meet and each is encoded once; the ids go back to their block, where the documents are put together by position.
Decoding joins the ids with the token-byte table.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table

LATIN = 0x250  # texts below this character are cut by a plain pattern, which is faster
BLOCK = 8 << 20  # bytes of text in a block; a longer text is a block of its own
LISTED = 1 << 16  # words of a row on its way; a row never holds more
KNOWN = 200_000  # words whose ids a task remembers, within one bucket
SHORT = 48  # bytes of a word that is merged by looking at all its pairs


# --- vocabulary ---------------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(1)
def classes() -> tuple[str, str]:
    """Letters and numbers as ranges for a character class, as the library's own pattern tables have them.

    Unicode versions differ in which characters are letters, so they are asked from the library: what a pattern of one
    class matches in the text of all characters.
    """
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    out = []
    for name in (r"\p{L}", r"\p{N}"):
        found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        points = np.unique(np.array([ord(c) for c in bytes(found).decode()]))
        cuts = np.flatnonzero(np.diff(points) > 1)
        firsts, lasts = points[np.append(0, cuts + 1)], points[np.append(cuts, len(points) - 1)]
        out.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts.tolist(), lasts.tolist())))
    return out[0], out[1]


def splitter(pattern: str, letters: str, numbers: str):
    """A function from a text to an iterator over lists of its pre-tokens; joined they are the text."""
    def written(p: str, letter: str, number: str) -> str:
        # Inside a class the ranges stand as they are, outside they are a class of their own.
        inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", letter).replace(r"\p{N}", number), p)
        return inside.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")

    def latin(kind: str) -> str:
        return "".join(re.escape(chr(i)) for i in range(LATIN) if unicodedata.category(chr(i))[0] == kind)

    # Python's own white space has four separators more than the library's; below LATIN these are all.
    blank = r" \t\n\x0b\x0c\r\x85\xa0"
    plain = written(pattern, latin("L"), latin("N"))
    plain = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", blank), plain).replace(r"\s", f"[{blank}]").replace(r"\S", f"[^{blank}]")
    fast, full, beyond = re.compile(plain), regex.compile(written(pattern, letters, numbers)), re.compile(f"[^\\0-{chr(LATIN - 1)}]")

    def split(text: str) -> Iterator[list[str]]:
        chosen = full if beyond.search(text) else fast
        if len(text) <= 1 << 20:
            yield chosen.findall(text)
            return
        part: list[str] = []
        for m in chosen.finditer(text):
            part.append(m[0])
            if len(part) == LISTED:
                yield part
                part = []
        yield part

    return split


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: itself if it is a token, else its bytes, of which the pair of lowest rank merges, the first of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    parts = [word[i: i + 1] for i in range(len(word))]
    none = len(ranks) + 256
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i: i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As `merge`, with a heap of pairs and linked neighbours, so that time grows as n log n."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here; 0 where none begins
    before = list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i: i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or ranks.get(word[i: end[middle]]) != rank:
            continue  # a neighbour has merged since
        last = end[middle]
        end[i], end[middle] = last, 0
        if last < n:
            before[last] = i
            if (r := ranks.get(word[i: end[last]])) is not None:
                heapq.heappush(heap, (r, i))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left: last])) is not None:
            heapq.heappush(heap, (r, left))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i: end[i]]])
        i = end[i]
    return out


# --- words of blocks ----------------------------------------------------------------------------


def _bucket(word: bytes, buckets: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % buckets


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as bytes, lowest bytes together, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Numbers(dict):
    """Words and their numbers, in the order in which they come first."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


class _Block:
    """Pre-tokens of some documents: distinct words, and for each document the numbers of its words in order."""

    def __init__(self) -> None:
        self.number = _Numbers()
        self.places: list[np.ndarray] = []
        self.size = 0
        self.documents: list[tuple] = []
        self.lengths: list[int] = []

    def add(self, row: tuple, text: str, split) -> None:
        n = 0
        for words in split(text):
            self.places.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
            n += len(words)
        self.documents.append(row)
        self.lengths.append(n)
        self.size += len(text)

    def key(self, task: int, count: int) -> bytes:
        """Names the block. It holds a digest of what the block says, so that a list never meets the places of another."""
        h = hashlib.blake2b(f"{task}:{count}:{self.documents!r}:{self.lengths!r}:".encode(), digest_size=16)
        for p in self.places:
            h.update(p.tobytes())
        h.update("".join(self.number).encode("utf-8", "surrogatepass"))
        return h.digest()


WORDS = "bucket int, block binary, part int, words binary, numbers binary"


def _blocks(df: DataFrame, columns: list[str], split_of) -> tuple[DataFrame, DataFrame]:
    """(words of blocks, layouts of blocks): what the two passes over the documents give out.

    Both cut the same partitions into the same blocks; a block's key covers its content, so if a partition ever came in
    another order, ids would be missing and the job would fail, not mix blocks up.
    """
    from pyspark import TaskContext

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, _Block]]:
        split, held, count = split_of(), _Block(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            texts, rows = batch.column("__text"), list(zip(*(batch.column(c).to_pylist() for c in columns)))
            for at in range(0, batch.num_rows, 64):
                for row, text in zip(rows[at: at + 64], texts.slice(at, 64).to_pylist()):
                    if held.size and held.size + len(text or "") > BLOCK:
                        yield held.key(task, count), held
                        held, count = _Block(), count + 1
                    held.add(row, text or "", split)
        if held.documents:
            yield held.key(task, count), held

    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def words(batches):
        for key, block in blocks(batches):
            listed = [(w.encode(), i) for w, i in block.number.items()]
            dealt: dict[int, list[tuple[bytes, int]]] = {}
            for w in listed:
                dealt.setdefault(_bucket(w[0], buckets), []).append(w)
            out = []
            for bucket, own in dealt.items():
                own.sort()
                for part, at in enumerate(range(0, len(own), LISTED)):
                    some = own[at: at + LISTED]
                    out.append((bucket, key, part, _list([w for w, _ in some]), _packed(np.array([i for _, i in some]))))
            yield _record(out, (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()), ("bucket", "block", "part", "words", "numbers"))

    def layouts(batches):
        for key, block in blocks(batches):
            places = np.concatenate(block.places) if block.places else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([len(block.number)], pa.int32()), pa.array([_packed(np.array(block.lengths))], pa.binary()),
                 pa.array([_packed(places)], pa.binary()), pa.array([[_text(r) for r in block.documents]], pa.list_(pa.list_(pa.string())))],
                ["block", "n_words", "lengths", "places", "documents"])

    source = df.select(*columns, "__text")
    return source.mapInArrow(words, WORDS), source.mapInArrow(
        layouts, "block binary, n_words int, lengths binary, places binary, documents array<array<string>>")


def _text(row: tuple) -> list[str | None]:
    return [None if v is None else str(v) for v in row]


def _list(items: list[bytes]) -> bytes:
    """Byte strings as one: their sizes, packed, behind the length of that, and all of them."""
    sizes = _packed(np.array([len(w) for w in items], np.uint32))
    return len(sizes).to_bytes(4, "little") + sizes + zlib.compress(b"".join(items), 1)


def _unlist(data: bytes) -> list[bytes]:
    head = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(_unpacked(data[4:head]), dtype=np.int64).tolist()
    joined = zlib.decompress(data[head:])
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def _record(rows: list[tuple], kinds: tuple, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def _encoded(words: DataFrame, ranks_of) -> DataFrame:
    """Rows of words with the ids of each: equal words have one bucket and are encoded once there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of()
        known: dict[bytes, tuple[int, ...]] = {}
        bucket = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                own, key = batch.column("bucket")[i].as_py(), batch.column("block")[i].as_py()
                if own != bucket or len(known) > KNOWN:
                    known, bucket = {}, own
                counts, ids = [], []
                for w in _unlist(batch.column("words")[i].as_py()):
                    found = known.get(w)
                    if found is None:
                        found = known[w] = tuple(merge(w, ranks))
                    counts.append(len(found))
                    ids += found
                out.append((key, batch.column("numbers")[i].as_py(), _packed(np.array(counts)), _packed(np.array(ids))))
            if out:
                yield _record(out, (pa.binary(),) * 4, ("block", "numbers", "counts", "ids"))

    dealt = words.repartition("bucket").sortWithinPartitions("bucket", "block", "part")
    return dealt.mapInArrow(run, "block binary, numbers binary, counts binary, ids binary")


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes by id, one behind the other, and where each begins."""
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    starts = np.zeros(len(by_id) + 1, np.int64)
    np.cumsum([len(t) for t in by_id], out=starts[1:])
    return np.frombuffer(b"".join(by_id), np.uint8), starts


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[0] .. starts[0] + sizes[0], starts[1] .., one range behind the other."""
    at = np.cumsum(sizes) - sizes
    return np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))


def encode(df: DataFrame, ranks_path: str, keep: str = "doc_id long", text_col: str = "text", ids: bool = False, pattern: str | None = None) -> DataFrame:
    """The kept columns, then n_tokens, ids_sha256 and decoded_sha256 of every text, and with `ids` the ids themselves.

    A null text is an empty one and has no tokens; repeated rows are encoded each; a text of any length is encoded whole,
    and so is a word of any length. `keep` names columns and their types, integers or strings. The vocabulary is broadcast:
    its size does not depend on the data. `df` should come from a table: its partitions are read twice.
    """
    import public_tokenizers

    spark = df.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    rules = spark.sparkContext.broadcast((pattern or public_tokenizers.PATTERN, *classes()))
    columns = [c.strip().split(" ")[0] for c in keep.split(",")]
    kinds = [c.strip().split(" ")[1] for c in keep.split(",")]
    words, layouts = _blocks(df.select(*columns, F.col(text_col).alias("__text")), columns, lambda: _splitter(*rules.value))
    encoded = _encoded(words, lambda: ranks.value)
    # A block's layout comes first, then the ids of its words.
    both = layouts.select("block", F.lit(0).alias("kind"), "n_words", "lengths", "places", "documents", *(F.lit(None).cast("binary").alias(c) for c in ("numbers", "counts", "ids"))) \
        .union(encoded.select("block", F.lit(1), F.lit(None).cast("int"), *(F.lit(None).cast("binary") for _ in range(2)), F.lit(None).cast("array<array<string>>"), "numbers", "counts", "ids"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts = token_bytes(ranks.value)
        numerals = [str(i) for i in range(len(starts) - 1)]
        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for key, own in groupby(rows, key=lambda r: r[0]):
            head = next(own)
            if head[1] != 0:
                raise RuntimeError("a block's words have no layout: its partition was not read in one order")
            yield from _documents(head, own, data, starts, numerals)

    def _documents(head, own, data, starts, numerals):
        n = head[2]
        word_sizes, word_starts, flat_ids = np.full(n, -1, np.int64), np.zeros(n, np.int64), []
        at = 0
        for r in own:
            if r[1] == 0:
                raise RuntimeError("a block came twice")
            numbers, counts, some = _unpacked(r[6]), _unpacked(r[7]).astype(np.int64), _unpacked(r[8])
            word_sizes[numbers] = counts
            word_starts[numbers] = at + np.cumsum(counts) - counts
            flat_ids.append(some)
            at += len(some)
        if n and word_sizes.min() < 0:
            raise RuntimeError("words of a block are missing: its partition was not read in one order")
        flat_ids = np.concatenate(flat_ids).astype(np.int64) if flat_ids else np.zeros(0, np.int64)
        lengths, places = _unpacked(head[3]).astype(np.int64), _unpacked(head[4]).astype(np.int64)
        first = 0
        for a in range(0, len(lengths), 512):
            out = []
            for length, document in zip(lengths[a: a + 512].tolist(), head[5][a: a + 512]):
                count, h, d, all_ids = 0, hashlib.sha256(), hashlib.sha256(), []
                for lo in range(first, first + length, LISTED):
                    own_words = places[lo: min(lo + LISTED, first + length)]
                    found = flat_ids[_gather(word_starts[own_words], word_sizes[own_words])]
                    text = " ".join([numerals[i] for i in found.tolist()])
                    h.update((" " + text if count and text else text).encode())
                    d.update(data[_gather(starts[found], starts[found + 1] - starts[found])].tobytes())
                    count += len(found)
                    if ids:
                        all_ids += found.tolist()
                first += length
                out.append((*document, count, h.hexdigest(), d.hexdigest(), all_ids))
            names = [*(f"__k{i}" for i in range(len(columns))), "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
            yield _record(out, (*(pa.string() for _ in columns), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())), tuple(names))

    placed = both.repartition("block").sortWithinPartitions("block", "kind")
    schema = "".join(f"__k{i} string, " for i in range(len(columns))) + "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    found = placed.mapInArrow(assemble, schema)
    return found.select(*(F.col(f"__k{i}").cast(kind).alias(c) for i, (c, kind) in enumerate(zip(columns, kinds))),
                        "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else []))


@lru_cache(2)
def _splitter(pattern: str, letters: str, numbers: str):
    return splitter(pattern, letters, numbers)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """key and decoded (binary) of rows of ids, by a join of every id with the token-byte table, put together by position.

    Rows are told apart by the key, which must not repeat; a row without ids has empty bytes. An id without a token is an error.
    """
    spark = encoded.sparkSession
    ranks = read_ranks(ranks_path)
    tokens = spark.createDataFrame([(i, bytearray(t)) for t, i in ranks.items()], "id int, bytes binary")
    placed = encoded.select(key, F.posexplode_outer(ids_col).alias("pos", "id")).join(tokens, "id", "left")
    known = F.when(F.col("id").isNull(), F.lit(b"")).otherwise(F.coalesce("bytes", F.raise_error(F.concat(F.lit("no token has the id "), F.col("id"))).cast("binary")))
    parts = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.hex(known).alias("b")))).alias("parts"))
    return parts.select(key, F.unhex(F.array_join(F.transform("parts", lambda p: p["b"]), "")).alias("decoded"))


def op13_bytebpe(spark: SparkSession, d: str, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """n_tokens and the digests of ids and decoded bytes of every document.

    Null and empty texts have no tokens (digests of nothing); repeated rows keep rows of their own, null ids stay null, and
    texts of any length are encoded whole.
    """
    import public_tokenizers

    return encode(table(spark, d, "documents"), public_tokenizers.path(name))
