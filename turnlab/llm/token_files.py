"""Token ids in binary files: frequency-ranked ids in bytes, their lengths in separate control bytes.

An id is written as its rank by frequency in the whole corpus, in 1 to 4 bytes; the 2-bit lengths of four numbers share
a control byte. A file holds the ids by rank, then blocks of whole documents: an index, control bytes, data bytes.
Control bytes and data of a block are decoded at once with table lookups.

Layout, little-endian: ``TLTOK1`` and two zero bytes; u32 vocabulary size; that many u32 ids by rank; blocks of
u32 documents, u64 control bytes, u64 data bytes, i64 document ids, u8 flags (1: no id), u32 token counts, control,
data. The numbers of a document are filled up with zeros to a multiple of four.
"""

import functools
import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlab.llm.common import local_path, scratch, small_batches, with_columns

MAGIC = b"TLTOK1\0\0"
END = 2
FILE_BYTES = 32 << 20    # of packed tokens wanted in a file
BLOCK_TOKENS = 1 << 20   # after which a block ends; a longer document is a block of its own
_KEPT, _LONGEST = 800_000, 64  # pieces in a table, and characters of a piece that is kept
_TOGETHER = 2_000        # new words encoded in one call
_GROUP = 2 << 20         # characters looked up at once
_BEHIND = ".,;:!?|$%&*#@\")]}"  # runs of their own behind letters

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The lengths of the four numbers behind each control byte, and the mask of a length.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_WEIGHTS = np.array([1, 4, 16, 64], np.uint8)


def pack(numbers):
    """(control, data) of non-negative numbers below 2**32."""
    x = np.zeros(-(-len(numbers) // 4) * 4, "<u4")
    x[:len(numbers)] = numbers
    extra = (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    control = (extra.reshape(-1, 4) * _WEIGHTS).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= extra[:, None]
    return control.tobytes(), x.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control, data):
    """The numbers of a stretch, four for each control byte."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    first = np.cumsum(lengths) - lengths
    raw = np.frombuffer(bytes(data) + b"\0\0\0", np.uint8)
    out = raw[first].astype(np.uint32)
    for i in range(1, 4):
        out |= raw[first + i].astype(np.uint32) << np.uint32(8 * i)
    return out & MASKS[lengths]


def _keeps_ascii_words(layout):
    """Whether a tokenizer of this layout hands words of the letters a to z to its model as they are."""
    def steps(part, many):
        return layout[part][many] if (layout[part] or {}).get("type") == "Sequence" else [layout[part] or {}]

    for step in steps("normalizer", "normalizers"):
        if step not in ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}):
            return False
    split, *rest = steps("pre_tokenizer", "pretokenizers")
    return (split.get("type") == "Split" and split["pattern"].get("Regex") == _SPLIT and split["behavior"] == "Removed" and split["invert"]
            and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
            and layout["post_processor"] is None)


class Encoder:
    """The tokenizer of a file, over pieces between spaces and line ends; ids come as little-endian bytes.

    Neither normalisation nor splitting of these tokenizers looks across such a place, so the pieces' ids make the
    text's. Pieces are kept in two tables of bounded size. A piece that is a word with punctuation behind it is put
    together from both, and new words are encoded many at a time: each ends with a token that is marked so.
    Special tokens in a text are ordinary text.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model if _keeps_ascii_words(json.loads(self.tokenizer.to_str())) else None
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.known, self.older = {"": b""}, {}

    def ids(self, text):
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)  # without offsets

    def encode(self, text):
        return self.encode_many([text])[0]

    def encode_many(self, texts):
        """The ids of some texts, as bytes each."""
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) >= _KEPT:
            self.known, self.older = {"": b""}, self.known
        new = set().union(*pieces).difference(self.known)
        self.learn(new)
        find = self.known.__getitem__
        out = [b"".join(map(find, p)) for p in pieces]
        for piece in new:
            if len(piece) > _LONGEST:
                del self.known[piece]
        return out

    def learn(self, pieces):
        """Put new pieces into the table."""
        known, older, words = self.known, self.older, set()
        whole, cores, tails = [], [], []  # not as tuples, which Python's collector would look through again and again
        for piece in pieces:
            found = older.get(piece)
            if found is not None:
                known[piece] = found
                continue
            core = piece.rstrip(_BEHIND)
            low = core.lower()
            if len(piece) <= _LONGEST and core.isalpha() and low.isalpha():  # letters alone are one run for any tokenizer
                word = low if core.isascii() else core
                whole.append(piece)
                cores.append(word)
                tails.append(piece[len(core):])
                if word not in known:
                    words.add(word)
            else:
                known[piece] = self.ids(piece).tobytes()
        self.learn_words(sorted(words))
        for behind in set(tails).difference(known):
            known[behind] = self.ids(behind).tobytes()
        for piece, word, behind in zip(whole, cores, tails):
            known[piece] = known[word] + known[behind] if behind else known[word]

    def learn_words(self, words):
        if self.model:
            for word in filter(str.isascii, words):  # in lower case, so nothing but the model has a say
                self.known[word] = np.array([t.id for t in self.model.tokenize(word)], self.type).tobytes()
            words = [w for w in words if not w.isascii()]
        for i in range(0, len(words), _TOGETHER):
            part = words[i:i + _TOGETHER]
            ids = self.ids(" ".join(part))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, width = ids.tobytes(), self.type.itemsize
                at = [0, *(stops * width).tolist()]
                self.known.update(zip(part, [raw[x:y] for x, y in zip(at, at[1:])]))
            else:  # this tokenizer marks no ends
                self.known.update((w, self.ids(w).tobytes()) for w in part)


@functools.lru_cache(maxsize=2)
def encoder(path):
    return Encoder(path)


def encode(docs, path, doc_id="doc_id", text="text", end=END):
    """(doc_id, ids) with ids as bytes of little-endian numbers (two bytes each up to 65,536 ids, else four), ``end``
    appended. A null or empty text has the end alone."""
    def run(texts):
        coder = encoder(path)
        last, out, part, size = np.array([end], coder.type).tobytes(), [], [], 0
        for i, t in enumerate(texts):
            part.append(t or "")
            size += len(part[-1])
            if size > _GROUP or i == len(texts) - 1:
                out += [ids + last for ids in coder.encode_many(part)]
                part, size = [], 0
        return [out]
    return with_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["text"], run,
                        "ids binary").select("doc_id", "ids")


def ids_by_frequency(encoded, path):
    """All ids of the vocabulary, most frequent in ``encoded`` first, then by number (a table as long as that)."""
    def run(batches):
        coder = encoder(path)
        total = np.zeros(coder.size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_py(), coder.type), minlength=coder.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])
    found = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(encoder(path).size, np.int64)
    for r in found:
        total[r["id"]] = r["n"]
    return np.argsort(-total, kind="stable").astype("<u4")


def write(docs, to, path, doc_id="doc_id", text="text", end=END):
    """Write the ids of all documents to files below ``to``, in ascending order of the document id.

    Ids are counted over the whole corpus. Documents without an id come first; rows that repeat an id are ordered by a
    hash of their ids. Files are named by the attempt that wrote them, and the table ``to``/manifest names
    those that count, so a lost or repeated task leaves no trace. An empty table writes a manifest without rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    encode(docs, path, doc_id, text, end).write.option("compression", "zstd").parquet(f"{to}/encoded")
    encoded = spark.read.parquet(f"{to}/encoded")
    order = ids_by_frequency(encoded, path)
    ranks = np.empty(len(order), "<u4")
    ranks[order] = np.arange(len(order))
    tables = spark.sparkContext.broadcast((order.tobytes(), ranks.tobytes()))  # as long as the vocabulary
    size = encoded.agg(F.sum(F.length("ids"))).first()[0] or 0
    files = max(1, -(-size * 2 // (3 * FILE_BYTES)))

    def put(batches):
        system, folder = local_path(to)
        ranked, kind = np.frombuffer(tables.value[1], "<u4"), encoder(path).type
        part, name, stream = TaskContext.get().partitionId(), None, None
        docs_n = tokens_n = 0
        block, held = [], 0
        for batch in batches:
            if stream is None and len(batch):
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
                system.create_dir(folder, recursive=True)
                stream = system.open_output_stream(f"{folder}/{name}")
                stream.write(MAGIC + np.array([len(order)], "<u4").tobytes() + tables.value[0])
            for doc, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, kind)
                if block and held + len(ids) > BLOCK_TOKENS:
                    _write_block(stream, block)
                    block, held = [], 0
                block.append((doc, len(ids), *pack(ranked[ids])))
                held += len(ids)
                docs_n += 1
                tokens_n += len(ids)
        if stream is not None:
            _write_block(stream, block)
            stream.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": docs_n, "n_tokens": tokens_n}])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", F.xxhash64("ids").alias("tie"))
    dealt = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    (dealt.mapInArrow(put, "part long, name string, n_docs long, n_tokens long")
     .write.parquet(f"{to}/manifest"))


def _write_block(stream, rows):
    ids = np.array([r[0] or 0 for r in rows], "<i8")
    control, data = b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)
    stream.write(np.array([len(rows)], "<u4").tobytes() + np.array([len(control), len(data)], "<u8").tobytes()
                 + ids.tobytes() + np.array([r[0] is None for r in rows], np.uint8).tobytes()
                 + np.array([r[1] for r in rows], "<u4").tobytes() + control + data)


def read_file(stream):
    """Blocks of an open file: (document ids with None, token counts, the ids of all its documents in one array)."""
    if stream.read(8) != MAGIC:
        raise ValueError("no token file")
    by_rank = np.frombuffer(stream.read(4 * int(np.frombuffer(stream.read(4), "<u4")[0])), "<u4")
    while head := stream.read(20):
        n, (controls, size) = int(np.frombuffer(head[:4], "<u4")[0]), np.frombuffer(head[4:], "<u8").tolist()
        ids = np.frombuffer(stream.read(8 * n), "<i8").tolist()
        null = np.frombuffer(stream.read(n), np.uint8)
        counts = np.frombuffer(stream.read(4 * n), "<u4").astype(np.int64)
        numbers = unpack(stream.read(controls), stream.read(size))
        room = -(-counts // 4) * 4
        place = np.repeat(np.cumsum(room) - room - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        yield [None if x else i for i, x in zip(ids, null)], counts, by_rank[numbers[place]]


def read(spark, to, as_bytes=False):
    """(doc_id, start, n_tokens, ids) of every document of the files below ``to``; ``start`` counts the ids of all
    documents before it. ``ids`` is an array, or with ``as_bytes`` the bytes of unsigned little-endian 32-bit numbers."""
    small_batches(spark)
    kind = "binary" if as_bytes else "array<long>"
    files = spark.read.schema("part long, name string, n_docs long, n_tokens long").parquet(f"{to}/manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    placed = files.select("name", F.coalesce(before, F.lit(0)).alias("start"))

    def get(batches):
        system, folder = local_path(to)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{folder}/{name}") as stream:
                    for ids, counts, tokens in read_file(stream):
                        begin = np.cumsum(counts) - counts
                        if as_bytes:
                            raw = tokens.astype("<u4").tobytes()
                            lists = pa.array([raw[4 * a:4 * (a + n)] for a, n in zip(begin.tolist(), counts.tolist())],
                                             pa.binary())
                        else:
                            lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, counts.sum()], pa.int32()),
                                                             pa.array(tokens.astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + begin),
                                                          pa.array(counts), lists],
                                                         names=["doc_id", "start", "n_tokens", "ids"])
                        start += int(counts.sum())

    n = max(1, spark.read.schema(files.schema).parquet(f"{to}/manifest").count())
    return placed.repartition(n, "name").mapInArrow(get, f"doc_id long, start long, n_tokens long, ids {kind}")


def written(docs, path, doc_id="doc_id", text="text"):
    """The folder of the shared directory to which the files of ``docs`` were written."""
    to = scratch(docs.sparkSession, "tokens")
    write(docs, to, path, doc_id, text)
    return to


def digest(rows):
    """The contract's columns of rows read with ``as_bytes``."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
