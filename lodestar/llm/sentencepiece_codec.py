"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes its characters, with a dummy blank in front and blanks as U+2581. An agenda of adjacent symbol pairs whose join is
a piece is worked off in the order of the piece's score, leftmost first at equal scores; what is left that isn't a piece becomes byte
pieces. No piece of a vocabulary of this kind holds U+2581 behind another character (checked on loading), so no merge crosses
the front of a run of blanks, and a text can be encoded in chunks that start there. Chunks repeat, so each distinct chunk is
encoded once for each Python worker, while a cache holds it: short ones together, one merge of each chunk a round over NumPy arrays; long ones by
a heap. The cache has two halves; what is used moves to the newer one, and the older goes when that is full, by chunks (CACHE) or by their
characters (CHARS), so that a worker, which lives on between stages, keeps some tens of MB whatever the texts.

Each new chunk is also encoded and decoded by the sentencepiece library, an Arrow batch's chunks at a time; where the two differ,
the library's answer is taken (the codec counts such chunks in repaired). Vocabularies that this doesn't cover (not BPE, a normaliser that changes
text, user-defined symbols, pieces across blanks) go to the library as a whole.

Null texts are empty: no ids, the empty decoding. Rows are encoded one by one, whole, of any length; repeated rows give repeated
results. Columns other than doc_id and text are ignored. The model's path must exist on every executor (it is part of the
environment, and is never copied).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import texts, tuned

BLANK = "▁"
CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*")
CACHE = 160_000
#: Characters of the chunks and ids of a half of the cache: chunks of texts without blanks are long.
CHARS = 4_000_000
#: Chunks of more symbols go through the heap.
SHORT = 48
#: Chunks that are learnt together.
AT_ONCE = 50_000
NONE = np.int64(1) << 40


class Codec:
    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        score = {i: sp.get_score(i) for i in plain}
        probe = "a  b ﬁÅ Å\tx "
        self.covered = (
            all(sp.is_byte(i) for i in self.bytes)
            and not any(re.search(f"[^{BLANK}]{BLANK}", x) for x in self.ids)
            and sp.normalize(probe) == BLANK + probe.replace(" ", BLANK)
            and len({score[i] for i in plain}) > 1
        )
        # scores as ranks: the best first; equal scores, equal ranks
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {i: order[s] for i, s in score.items()}
        # symbols: pieces by id, and further characters behind them as they turn up
        self.symbol = dict(self.ids)
        self.names = list(self.pieces)
        keys, ranks, joined = [], [], []
        for text, i in self.ids.items():
            for cut in range(1, len(text)):
                a, b = text[:cut], text[cut:]
                if (a in self.ids or cut == 1) and (b in self.ids or len(b) == 1):
                    keys.append(self._symbol(a) << 32 | self._symbol(b))
                    ranks.append(self.rank[i])
                    joined.append(i)
        at = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.zeros(0, int)
        self.keys, self.ranks, self.joined = (np.array(x, np.int64)[at] if keys else np.zeros(0, np.int64) for x in (keys, ranks, joined))
        self.size = size
        self.text = [None if sp.is_byte(i) else x.replace(BLANK, " ") for i, x in enumerate(self.pieces)]
        self.digits = [str(i) for i in range(size)]
        self.of_char = np.full(0x110000, -1, np.int64)
        self.of_char[ord(BLANK)] = self._symbol(BLANK)
        #: ids joined by commas, by chunk without the blank in front; with the decoded text, where that isn't a blank and the chunk
        self.cache: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}
        self.held = 0
        self.repaired = 0

    def _symbol(self, text: str) -> int:
        if (i := self.symbol.get(text)) is None:
            i = self.symbol[text] = len(self.names)
            self.names.append(text)
        return i

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair the rank and the id of its join; NONE where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.joined[at], -1)

    def agenda(self, chunk: str) -> list[str]:
        """The merges of one chunk by a heap of (rank, place) over a linked list of symbols."""
        part = list(chunk)
        ahead, behind = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            j = ahead[i]
            if j < len(part) and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (self.rank[k], i, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = ahead[i]
            if part[i] != a or j >= len(part) or part[j] != b or not a:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = a + b, ""
            ahead[i] = ahead[j]
            if ahead[j] < len(part):
                behind[ahead[j]] = i
            offer(i)
            if behind[i] >= 0:
                offer(behind[i])
        return [x for x in part if x]

    def lockstep(self, chunks: list[str]) -> Iterator[list[int]]:
        """The merges of many short chunks, the best pair of each in every round; symbols of each chunk."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.of_char[points]
        if (sym < 0).any():
            for c in np.unique(points[sym < 0]).tolist():
                self.of_char[c] = self._symbol(chr(c))
            sym = self.of_char[points]
        own = np.repeat(np.arange(len(chunks)), [len(x) for x in chunks])
        ended: list[tuple[np.ndarray, np.ndarray]] = []

        def pairs() -> tuple[np.ndarray, np.ndarray]:
            rank, join = np.full(len(sym), NONE), np.full(len(sym), -1, np.int64)
            near = np.flatnonzero(own[:-1] == own[1:])
            rank[near], join[near] = self._pairs(sym[near], sym[near + 1])
            return rank, join

        rank, join = pairs()
        while len(sym):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            order = rank * 64 + (np.arange(len(sym)) - np.repeat(starts, sizes))  # leftmost at equal ranks; SHORT < 64
            best = np.minimum.reduceat(order, starts)
            live = best < NONE * 64
            keep = np.repeat(live, sizes)
            if not live.all():
                ended.append((own[~keep], sym[~keep]))  # a chunk's symbols end together
            at = starts[live] + best[live] % 64
            sym[at] = join[at]
            keep[at + 1] = False  # the right half of each merge
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, own, rank, join = sym[keep], own[keep], rank[keep], join[keep]
            for i in (at, at - 1):  # the pairs that the merged symbol is part of
                i = i[i >= 0]
                near = i[i + 1 < len(sym)]
                rank[i] = NONE
                same = near[own[near] == own[near + 1]]
                rank[same], join[same] = self._pairs(sym[same], sym[same + 1])
        own, sym = (np.concatenate([x[i] for x in ended]) if ended else np.zeros(0, np.int64) for i in (0, 1))
        sym = sym[np.argsort(own, kind="stable")].tolist()
        at = 0
        for n in np.bincount(own, minlength=len(chunks)).tolist():
            yield sym[at : at + n]
            at += n

    def finish(self, symbols: list[int]) -> list[int]:
        """Ids of symbols: those that aren't pieces become bytes."""
        if not symbols or max(symbols) < self.size:
            return symbols
        return [i for s in symbols for i in ([s] if s < self.size else (self.bytes[b] for b in self.names[s].encode()))]

    def unjoin(self, ids: list[int]) -> str:
        """The text of ids, with the blank in front as it is; runs of byte pieces as UTF-8."""
        parts = [self.text[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out, run = [], bytearray()
        for i, part in zip(ids, parts, strict=True):
            if part is None:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(part)
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def learn(self, keys: list[str]) -> None:
        """Encodes new chunks, each given without the blank in front, and checks them against the library."""
        short = [x for x in keys if len(x) < SHORT]
        long = [x for x in keys if len(x) >= SHORT]
        found = [self.finish(x) for x in self.lockstep([BLANK + x for x in short])] if short else []
        found += [self.finish([self._symbol(c) for c in self.agenda(BLANK + x)]) for x in long]
        theirs = self.library.encode([x.replace(BLANK, " ") for x in short + long], num_threads=1)
        decoded = self.library.decode(theirs, num_threads=1)
        for key, ids, ref, text in zip(short + long, found, theirs, decoded, strict=True):
            mine = self.unjoin(ids)
            if key and (ids != ref or mine[1:] != text):  # the library encodes a lone blank in front as nothing
                self.repaired += 1
                ids, mine = ref, " " + text
            joined = ",".join([self.digits[i] for i in ids])
            self.cache[key] = joined if mine[:1] == " " and mine[1:] == key else (joined, mine)
            self.held += len(key) + len(joined)

    def turn(self) -> None:
        """Where the newer half of the cache is full, it becomes the older one."""
        if len(self.cache) >= CACHE // 2 or self.held >= CHARS:
            self.older, self.cache, self.held = self.cache, {}, 0

    def hold(self, chunks: Iterable[str]) -> None:
        """Chunks that aren't in the newer half of the cache come from the older one, or are learnt."""
        new = []
        for x in chunks:
            if (got := self.older.get(x)) is None:
                new.append(x)
            else:
                self.cache[x] = got
                self.held += len(x) + len(got if isinstance(got, str) else got[0])
        if new:
            self.learn(new)

    def split(self, text: str) -> list[str]:
        """Chunks, each without the blank in front."""
        if not text:
            return []
        if "  " not in text and BLANK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in CHUNK.findall(BLANK + text.replace(" ", BLANK))]

    def encode_batch(self, rows: list[str]) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each row."""
        if not self.covered:
            ids = self.library.encode(rows, num_threads=1)
            return list(zip((",".join(map(str, x)) for x in ids), self.library.decode(ids, num_threads=1), strict=True))
        out, split = [], [self.split(row) for row in rows]
        self.turn()
        new = dict.fromkeys(x for row in split for x in row if x not in self.cache)
        if len(new) <= AT_ONCE:
            self.hold(new)
        for chunks in split:
            got = [self.cache.get(x) for x in chunks]
            if None in got:  # many new chunks, or some that had to go: a part at a time, so that the cache stays bounded
                got = []
                for at in range(0, len(chunks), AT_ONCE):
                    part = chunks[at : at + AT_ONCE]
                    self.turn()
                    self.hold(dict.fromkeys(x for x in part if x not in self.cache))
                    got += [self.cache[x] for x in part]
            if tuple in set(map(type, got)):
                whole = [(x, " " + key) if isinstance(x, str) else x for key, x in zip(chunks, got, strict=True)]
                out.append((",".join([x[0] for x in whole]), "".join([x[1] for x in whole])[1:]))
            else:
                out.append((",".join(got), " ".join(chunks)))
        return out


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """One for each Python worker."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(documents: DataFrame, model: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row for each row of documents: the digests, with with_ids also ids array<int>, with with_text the decoded text."""
    tuned(documents.sparkSession)
    schema = SCHEMA + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                rows = texts(part.column(1))
                got = c.encode_batch(rows)
                cols = [
                    part.column(0).cast(pa.int64()),
                    pa.array([x.count(",") + 1 if x else 0 for x, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _ in got], pa.string()),
                    pa.array([hashlib.sha256(y.encode()).hexdigest() for _, y in got], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([np.fromstring(x, np.int32, sep=",") for x, _ in got], pa.list_(pa.int32())))
                    names.append("ids")
                if with_text:
                    cols.append(pa.array([y for _, y in got], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
