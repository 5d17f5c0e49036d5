"""Byte-level BPE encoding by a lazily determinised finite-state transducer, and streaming UTF-8 decoding.

Encoding. A sequence of tokens is the BPE encoding of its bytes just when every adjacent pair is one that the merges
leave apart. So the merges compile into a nondeterministic transducer: a hypothesis is (bytes of the token being read,
last finished token, tokens not yet emitted); on each byte it reads on, and where its bytes are a token that may follow
the last one, it also finishes that token. Of the finished hypotheses exactly one survives at each byte. The sets of
hypotheses are the states of the deterministic transducer; they and their transitions are made when first met and kept
in a table of bounded size. What all hypotheses of a state agree on is emitted: no token waits for more bytes than the
longest token has.

Text is cut after each run of non-spaces; no match of the pattern crosses such a cut. A task encodes each distinct piece
once and keeps bounded tables, so memory does not grow with the input.

Decoding. Utf8Stream takes token bytes in any portions and holds back at most three bytes of an unfinished character.

Defined results: a null or empty text has no ids; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinespark.llm.common import ragged, same_spans, span_hashes, text_or_empty, text_slices

#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 19
#: White space as the tokenizer libraries' patterns see it (Unicode White_Space). Fixed values.
WHITE = "\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}


class Transducer:
    """The deterministic transducer of one rank table, built as bytes come."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 120_000):
        if missing := [k for k in range(256) if bytes([k]) not in ranks]:
            raise ValueError(f"a rank table needs all 256 single bytes; {len(missing)} are missing, the first is {missing[0]:#04x}")
        if max(ranks.values()) >= 1 << 20:
            raise ValueError("ranks of 20 bits at most")
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[int, bool] = {}
        # the trie of the tokens: node << 8 | byte to node; the token that ends at a node, or -1
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                below = self.child.get(node << 8 | byte)
                if below is None:
                    below = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = below
            self.token_at[node] = rank
        self.reset()

    def reset(self) -> None:
        self.state_ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self.state(((0, -1, ()),))

    def state(self, hypotheses: tuple) -> int:
        """The state with these hypotheses: (trie node of the token being read, last finished token, tokens to emit)."""
        if (at := self.state_ids.get(hypotheses)) is None:
            at = self.state_ids[hypotheses] = len(self.states)
            self.states.append(hypotheses)
        return at

    def halves_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: (-1, -1) for a byte, None if merging its bytes doesn't end in it."""
        if token not in self.halves:
            word = self.bytes_of[token]
            parts, last = [word[k : k + 1] for k in range(len(word))], (b"", b"")
            while len(parts) > 1:
                rank, at = min(((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
                if rank == 1 << 60:
                    break
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            whole = len(parts) == 1
            self.halves[token] = None if not whole else (-1, -1) if len(word) == 1 else (self.ranks[last[0]], self.ranks[last[1]])
        return self.halves[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave the bytes of a and b as those two tokens.

        The pieces that touch the border are a's right and b's left halves, taken apart again from the latest merge back.
        Had two of them formed a token before either was merged away (on a tie, the left merge comes first), the border
        would be gone.
        """
        if (known := self.follows.get(a << 20 | b)) is not None:
            return known
        x, y, until_x, until_y = a, b, 1 << 60, 1 << 60
        good = self.halves_of(b) is not None
        while good and a >= 0:
            rank = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if rank is not None and rank < until_x and rank <= until_y:
                good = False
                break
            hx, hy = self.halves_of(x), self.halves_of(y)
            born_x, born_y = (x if hx[0] >= 0 else -1), (y if hy[0] >= 0 else -1)
            if born_x < 0 and born_y < 0:
                break
            # the later of the two merges is undone; of equal ones the right one came later
            if born_x > born_y:
                until_x, x = x, hx[1]
            else:
                until_y, y = y, hy[0]
        self.follows[a << 20 | b] = good
        return good

    def step(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live = []
        child, token_at, follows = self.child, self.token_at, self.follows
        for node, last, out in self.states[at]:
            below = child.get(node << 8 | byte)
            if below is None:
                continue
            live.append((below, last, out))
            token = token_at[below]
            if token >= 0:
                good = follows.get(last << 20 | token)
                if self.may_follow(last, token) if good is None else good:
                    live.append((0, token, (*out, token)))
        shared = live[0][2]
        for _, _, out in live:
            if out[: len(shared)] != shared:
                k = 0
                while k < len(out) and shared[k] == out[k]:
                    k += 1
                shared = shared[:k]
        if cut := len(shared):
            live = [(node, last, out[cut:]) for node, last, out in live]
        made = self.next[at << 8 | byte] = (self.state(tuple(live)), shared)
        return made

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pattern match; a match that is itself a token is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        if len(self.follows) > 8 * self.max_states:
            self.follows.clear()
        ids: list[int] = []
        at, step = self.start, self.next
        for byte in piece:
            at, out = step.get(at << 8 | byte) or self.step(at, byte)
            if out:
                ids += out
        if piece:
            ids += next(out for node, _, out in self.states[at] if not node)
        return ids


class PieceEncoder:
    """Ids of texts from the ids of their distinct pieces: white space and the run of non-spaces after it.

    encode_pieces turns strings to lists of ids. Pieces are looked up by hash and their bytes compared; one that shares its
    hash with another is encoded by itself. The table of pieces seen is bounded: beyond `limit` it starts anew. Without
    `cuts` a text is one piece.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[list[int]]], limit: int = 1_500_000, cuts: bool = True):
        self.encode_pieces, self.limit, self.cuts = encode_pieces, limit, cuts
        self.forget()

    def forget(self) -> None:
        self.keys, self.ids, self.text = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.at, self.n, self.text_at, self.text_n = (np.zeros(0, np.int32) for _ in range(4))

    @staticmethod
    def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces and, by row, the first piece. A cut needs a character before it that is surely no space."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n + 1, bool)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        cut[1:n] = space[1:] & ~space[:-1]
        at = np.flatnonzero(cut)
        one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        unsure = (one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))) | ((one >= 0x1C) & (one <= 0x1F))
        cut[at[unsure]] = False
        cut[offsets] = True
        cut[n] = False
        at = np.flatnonzero(cut)
        return at, np.searchsorted(at, offsets)

    def made(self, raw: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these pieces, and how many each has."""
        ids = self.encode_pieces([raw[a : a + n].decode() for a, n in zip(starts.tolist(), lens.tolist(), strict=True)])
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for part in ids for x in part), np.int32, int(n.sum())), n

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and n + 1 bounds of the rows in them."""
        starts, rows = self.pieces(data, offsets) if self.cuts else (offsets[:-1], np.arange(len(offsets)))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        lens = np.diff(np.append(starts, len(data)))
        keys, first, which = np.unique(span_hashes(data, starts, lens), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            if len(self.keys) + len(new) > self.limit or len(self.ids) + len(self.text) + len(data) > 64 * self.limit:
                self.forget()
                new = np.arange(len(keys))
            n_text = lens[first[new]]
            ids, n = self.made(data.tobytes(), starts[first[new]], n_text)
            stays = np.where(n_text > 8, n_text, 0)  # bytes that will have to be compared
            begin, text_at = len(self.ids) + np.cumsum(n) - n, len(self.text) + np.cumsum(stays) - stays
            self.ids, self.text = np.concatenate([self.ids, ids]), np.concatenate([self.text, data[ragged(starts[first[new]], stays)]])
            to = np.searchsorted(self.keys, keys[new])
            self.keys, self.at, self.n = np.insert(self.keys, to, keys[new]), np.insert(self.at, to, begin), np.insert(self.n, to, n)
            self.text_at, self.text_n = np.insert(self.text_at, to, text_at), np.insert(self.text_n, to, n_text)
            at = np.searchsorted(self.keys, keys)
        here = at[which]
        begin, count, ids = self.at[here].astype(np.int64), self.n[here].astype(np.int64), self.ids
        # equal hashes of equal lengths up to 8 bytes are equal bytes (the hash is one to one there); longer ones are compared
        other = self.text_n[here] != lens
        long = np.flatnonzero((lens > 8) & ~other)
        other[long] = ~same_spans(data, starts[long], self.text, self.text_at[here[long]], lens[long])
        if other.any():
            apart, n = self.made(data.tobytes(), starts[other], lens[other])
            begin[other], count[other] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, apart])
        return ids[ragged(begin, count)], np.concatenate([[0], np.cumsum(count)])[rows]


class Utf8Stream:
    """Incremental UTF-8: feed() returns the text of the finished characters; unfinished ones wait (3 bytes at most).

    States are what is still due of a character: its length and the range of its next byte. A wrong byte gives U+FFFD.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(tail: bytes) -> int:
        """Bytes at the end that begin a character without ending it."""
        for back in range(1, min(3, len(tail)) + 1):
            byte = tail[-back]
            if byte >= 0xC0:
                due = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                second = tail[-back + 1] if back > 1 else None
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                fits = 0xC2 <= byte <= 0xF4 and (second is None or low <= second <= high)
                return back if fits and back < due else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, portion: bytes) -> str:
        portion = self.held + portion
        keep = self.unfinished(portion[-3:])
        self.held = portion[len(portion) - keep :]
        return portion[: len(portion) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def rust_pattern(pattern: str) -> str:
    r"""The pattern for the regex module with \s and \S as Unicode White_Space."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


_CODERS: dict[tuple[str, str], tuple[PieceEncoder, list[bytes]]] = {}


def coder(path: str, pattern: str) -> tuple[PieceEncoder, list[bytes]]:
    """This worker's encoder and token bytes; the transducer outlives the task."""
    if (path, pattern) not in _CODERS:
        import regex

        machine, split = Transducer(read_ranks(path)), regex.compile(rust_pattern(pattern))
        table = [machine.bytes_of.get(k, b"") for k in range(max(machine.bytes_of) + 1)]
        encode = machine.encode

        def pieces(texts: list[str]) -> list[list[int]]:
            return [[x for m in split.findall(t) for x in encode(m.encode())] for t in texts]

        _CODERS[path, pattern] = PieceEncoder(pieces), table
    return _CODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = coder(path, pattern)
        for part, data, offsets in text_slices(batches, "__text", ENCODE_BYTES):
            ids, bounds = encoder(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("__id"), lists], names=["id", "ids"])

    return docs.select(docs[id_col].alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", portion: int = 4096) -> DataFrame:
    """(id, text) from ids: the tokens' bytes go through Utf8Stream in portions. Null ids are an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = coder(path, pattern)
        for batch in batches:
            texts = [decoded(ids or [], table, portion) for ids in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(["".join(t) for t in texts], pa.string())], names=["id", "text"])

    return encoded.select(encoded[id_col].alias("__id"), encoded["ids"].alias("__ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def decoded(ids: list[int], table: list[bytes], portion: int = 4096) -> Iterator[str]:
    stream = Utf8Stream()
    for at in range(0, len(ids), portion):
        yield stream.feed(b"".join([table[x] for x in ids[at : at + portion]]))
    yield stream.end()


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", portion: int = 4096) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every text: encode and streaming decode in one pass of a slice."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = coder(path, pattern)
        for part, data, offsets in text_slices(batches, "__text", ENCODE_BYTES):
            ids, bounds = encoder(data, offsets)
            raw, flat = ids.astype("<u4").tobytes(), ids.tolist()
            sums, back = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sums.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                whole = hashlib.sha256()
                for text in decoded(flat[a:b], table, portion):
                    whole.update(text.encode())
                back.append(whole.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(np.diff(bounds), pa.int64()), pa.array(sums), pa.array(back)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    read = docs.select(docs[id_col].alias("__id"), text_or_empty(text_col).alias("__text"))
    return read.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
