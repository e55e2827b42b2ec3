"""SentencePiece encoding that keeps the place of every piece in the original bytes.

A text is normalised through the model's compiled character map: at each place the longest prefix that the
map's double-array trie holds is replaced, and every byte written remembers where its source begins. The
normalised text is cut before each run of space marks, which no piece crosses, and each cut is merged by the
pieces' scores (kept in a bounded cache, as words repeat). A piece's ends, looked up in the alignment, are its
span in the original UTF-8. Ids, spans and decoded texts equal those of the sentencepiece library.

NULL and empty texts have the begin and end ids only. Texts of any length are taken whole, in time n log n;
repeated rows are encoded each; an empty table gives no row; columns that clash with the added ones raise.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import table
from flowsieve.llm.tokens import tokenizer_path

#: The library's mark for a space, U+2581.
SPACE = "▁".encode()
#: Bytes of output held before they are passed on.
FLUSH = 4 << 20
#: Chunks up to this many bytes are remembered.
SHORT = 64
KEEP = 400_000


class CharacterMap:
    """The normaliser's compiled map: a double-array trie over byte prefixes, then the replacements.

    Trie units are 32-bit: bits 0 to 7 and 31 the label, bit 8 that a value follows, bits 10 to 30 the offset,
    shifted by 8 if bit 9 is set.
    """

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        self.first = bytes(b for b in range(256) if self._step(self._root(), b) is not None) if self.units else b""

    def _root(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << (8 if unit >> 9 & 1 else 0)

    def _step(self, at: int, byte: int) -> tuple[int, int] | None:
        """The place behind the byte's edge and its unit."""
        at ^= byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return None
        return at ^ self._offset(self.units[at]), self.units[at]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix at ``start`` that the map holds."""
        at, found = self._root(), None
        for k in range(start, len(data)):
            step = self._step(at, data[k])
            if step is None:
                break
            at, unit = step
            if unit >> 8 & 1:
                found = k + 1 - start, self.units[at] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The mapped bytes, and where the source of each begins; one more place for the end."""
        if not self.first:
            return data, np.arange(len(data) + 1)
        out, sources, plain = [], [], 0

        def untouched(until: int) -> None:
            out.append(data[plain:until])
            part = np.frombuffer(data, np.uint8, until - plain, plain)
            starts = np.where((part & 0xC0) != 0x80, np.arange(plain, until), 0)  # a character is one source
            sources.append(np.maximum.accumulate(starts) if len(part) else starts)

        k = 0
        while k < len(data):
            found = self.longest(data, k) if data[k] in self.first else None
            if found is None:
                k += 1
                while k < len(data) and data[k] & 0xC0 == 0x80:
                    k += 1
                continue
            untouched(k)
            out.append(found[1])
            sources.append(np.full(len(found[1]), k))
            k += found[0]
            plain = k
        untouched(len(data))
        return b"".join(out), np.concatenate([*sources, [len(data)]]).astype(np.int64)


class PieceEncoder:
    """Ids and spans by a SentencePiece BPE model with byte fallback; one per worker process."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            blob = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        kinds = model.SentencePiece
        normal = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        trainer, rules = model.trainer_spec, model.normalizer_spec
        marked = [p for p in normal if SPACE.decode() in p.lstrip(SPACE.decode())]
        odd = [p.piece for p in model.pieces if p.type in (kinds.USER_DEFINED, kinds.UNUSED)]
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or marked or odd:
            raise ValueError("only BPE models with byte fallback, without pieces across spaces, user-defined or unused pieces")
        if not rules.escape_whitespaces:
            raise ValueError("the model must mark spaces")
        self.scores = {p: -s for p, (s, _) in normal.items()}
        self.ids = {p: i for p, (_, i) in normal.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.width = np.zeros(len(model.pieces), np.int64)
        for piece, k in self.ids.items():
            self.width[k] = len(piece.encode())
        for byte, k in enumerate(self.bytes):
            self.width[k] = -(1 + sum(byte >= least for least in (0xC0, 0xE0, 0xF0))) if byte & 0xC0 != 0x80 else 0
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.trim = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def normalised(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The text as the pieces see it, and for each of its bytes and its end the place in ``data``."""
        text, source = self.map.apply(data)
        if not data:
            return b"", source
        values = np.frombuffer(text, np.uint8)
        blank = values == 32
        if self.trim:
            before = np.concatenate(([True], blank[:-1]))
            keep = ~(blank & before)
            if not keep.any():
                return b"", source[-1:]
            values, blank, source = values[keep], blank[keep], np.append(source[:-1][keep], source[-1])
            text = values.tobytes()
        marked = text.replace(b" ", SPACE)
        source = np.append(np.repeat(source[:-1], np.where(blank, len(SPACE), 1)), source[-1])
        if self.prefix:
            marked, source = SPACE + marked, np.concatenate((np.full(len(SPACE), source[0]), source))
        if self.trim and marked.endswith(SPACE):
            marked = marked.decode().rstrip(SPACE.decode()).encode()
            source = source[: len(marked) + 1]
        return marked, source

    def _merged(self, text: str) -> list[str]:
        """Neighbours join in order of score, the left of equals first, while the vocabulary holds them."""
        parts, score = list(text), self.scores
        if len(parts) <= 40:
            nothing = float("inf")
            ranks = [score.get(a + b, nothing) for a, b in zip(parts, parts[1:])]
            while ranks and (best := min(ranks)) != nothing:
                k = ranks.index(best)
                parts[k] += parts.pop(k + 1)
                del ranks[k]
                if k:
                    ranks[k - 1] = score.get(parts[k - 1] + parts[k], nothing)
                if k < len(ranks):
                    ranks[k] = score.get(parts[k] + parts[k + 1], nothing)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(s, k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (s := score.get(a + b)) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, joined = heapq.heappop(queue)
            j = after[k]
            if not parts[k] or j >= len(parts) or parts[k] + parts[j] != joined:
                continue
            parts[k], parts[j] = joined, ""
            after[k] = after[j]
            if after[k] < len(parts):
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < len(parts) and (s := score.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(queue, (s, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of one cut; a character without a piece is its bytes."""
        ids = array("I")
        for piece in self._merged(chunk.decode()):
            known = self.ids.get(piece)
            if known is None:
                ids.extend(self.bytes[b] for b in piece.encode())
            else:
                ids.append(known)
        return ids.tobytes()

    def _remembered(self, key: bytes) -> bytes:
        found = self.cache.get(key)
        if found is None:
            found = self.older.get(key) or self._chunk(SPACE + key)
            if len(key) <= SHORT:
                if len(self.cache) >= KEEP:
                    self.older, self.cache = self.cache, {}
                self.cache[key] = found
        return found

    def _widths(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of normalised text behind each id; of a character in bytes, the last id has them all."""
        widths = self.width[ids]
        first = np.flatnonzero(widths < 0)  # the first byte of a character tells how many there are
        widths[first + -widths[first] - 1] = -widths[first]
        widths[first[widths[first] < 0]] = 0
        return widths

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end, and the byte span of each in ``data``; begin and end have empty spans."""
        text, source = self.normalised(data)
        head, *rest = text.split(SPACE)
        found = [self._chunk(head)] if head else []
        run = 0
        for part in rest:
            if part:
                found.append(self._remembered(SPACE * run + part))
                run = 0
            else:
                run += 1
        if run:
            found.append(self._remembered(SPACE * (run - 1)))
        ids = np.frombuffer(b"".join(found), np.uint32)
        widths = self._widths(ids)
        ends = widths.cumsum()
        begins, ends = source[ends - widths], source[ends]
        edge, last = np.zeros(1, np.int64), np.full(1, len(data))
        framed = np.concatenate(([self.begin], ids, [self.end])).astype("<u4")
        return framed, np.concatenate((edge, begins, last)), np.concatenate((edge, ends, last))

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


ADDED = [
    T.StructField("ids", T.BinaryType()),
    T.StructField("begins", T.BinaryType()),
    T.StructField("ends", T.BinaryType()),
    T.StructField("decoded", T.StringType()),
]


def with_pieces(docs: DataFrame, path: str) -> DataFrame:
    """Replaces ``text`` by its ``ids`` with begin and end id, the ``begins`` and ``ends`` of their byte spans, all
    as little-endian 32-bit integers, and the ``decoded`` text of the ids."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    clash = {f.name.lower() for f in rest} & {f.name for f in ADDED}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are added; rename those of the table")
    schema = T.StructType([*rest, *ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            others = [k for k in range(batch.num_columns) if k != at]
            done, size, held = 0, 0, ([], [], [], [])
            for row in range(batch.num_rows):
                ids, begins, ends = encoder.encode(batch.column(at)[row].as_py() or b"")
                values = ids.tobytes(), begins.astype("<u4").tobytes(), ends.astype("<u4").tobytes(), encoder.decode(ids)
                for column, value in zip(held, values):
                    column.append(value)
                size += 4 * len(values[0])
                if size > FLUSH or row == batch.num_rows - 1:
                    kept = [batch.column(k).slice(done, row + 1 - done) for k in others]
                    made = [pa.array(column, pa.string() if k == 3 else pa.binary()) for k, column in enumerate(held)]
                    yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)
                    done, size, held = row + 1, 0, ([], [], [], [])

    binary = F.col("text").cast("binary").alias("text")
    return docs.select(*[F.col(f"`{f.name}`") for f in rest], binary).mapInArrow(run, schema)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, of the decoded text and of the pieces' byte spans for every document."""
    found = with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"),
    )
