"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

Encoding. For every prefix of a piece, BPE has one last token, and a sequence is
BPE's own result exactly if each adjacent pair is BPE's result for the pair's
bytes. So a machine reads bytes and holds a set of live hypotheses, each a node of the
token trie and, in a register, the token before that node's start. A byte moves each hypothesis; of those
that complete a token, the one whose token is compatible with its register gives the (unique)
last token. The sets are determinised on demand by their nodes: each distinct set becomes a state, each (state, byte) an
entry of the transition table, computed when first met, with the tokens that may end there. Sets that differ in registers
alone are one state, as the registers are the machine's own last outputs, no further back than the longest token.
States and judged pairs are dropped when there are ``max_states`` and grow anew, so memory is bounded.
Tokens are emitted after bounded lookahead: up to the last position that lies on the
token chain of every live hypothesis, none of which reaches back further than the
longest token.

Decoding runs tokens through an incremental UTF-8 state machine, which carries an unfinished character (3 bytes
at most) from one token and one block to the next; a token of whole characters leads from its first state back to
it, so blocks of such tokens need no look at single bytes. What the machine emits is what is digested.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_groups

#: Unicode White_Space, which ``\s`` stands for in the split pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLOCK = 4096
NEVER = 1 << 60
KEY = -1


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Rank file: base64 token, space, rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


class Transducer:
    BITS = 20  # of a token

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000):
        self.ranks, self.max_states = ranks, max_states
        n = max(ranks.values(), default=0) + 1
        if n >> self.BITS:
            raise ValueError("the vocabulary is too large for the table")
        self.token: list[bytes] = [b""] * n
        self.size = array("i", bytes(4 * n))
        self.child: dict[int, int] = {}  # node << 8 | byte -> node; 0 is the root
        self.at, self.depth, self.inner = array("i", [-1]), array("i", [0]), bytearray([1])
        for t, r in ranks.items():
            self.token[r], self.size[r] = t, len(t)
            node = 0
            for b in t:
                self.inner[node] = 1
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.at)
                    self.at.append(-1)
                    self.inner.append(0)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[key]
            self.at[node] = r
        self._reset()

    def _reset(self) -> None:
        # (state << 8 | byte) -> (next state, shortest token that may end there, longer ones as (length, token), longest first)
        self.table: dict[int, tuple[int, int, tuple]] = {}
        self.states: dict[tuple[int, ...], int] = {(0,): 0}
        self.nodes = [(0,)]
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """BPE by its definition, for single tokens."""
        return self._history(data)[0]

    def _history(self, data: bytes):
        """(parts, left edge, right edge, ranks rise): an edge lists each part that stood there
        as (part, rank that made it, rank that took it in)."""
        parts = [data[i:i + 1] for i in range(len(data))]
        left, right, born, rises, latest = [], [], [-1, -1], True, -1
        while len(parts) > 1:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if r == NEVER:
                break
            rises, latest = rises and r >= latest, r
            if i == 0:
                left.append((parts[0], born[0], r))
                born[0] = r
            if i == len(parts) - 2:
                right.append((parts[-1], born[1], r))
                born[1] = r
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        left.append((parts[0], born[0], NEVER))
        right.append((parts[-1], born[1], NEVER))
        return parts, left, right, rises

    def _edges(self, token: int):
        e = self.edges.get(token)
        if e is None:
            parts, left, right, rises = self._history(self.token[token])
            e = self.edges[token] = left, right, rises, len(parts) == 1
        return e

    def follows(self, before: int, token: int) -> bool:
        """Whether BPE of both tokens' bytes is these two tokens (``before`` < 0: the token alone).

        Up to the first merge over the border both sides merge as they do alone. So it is
        enough that no part on the right edge of the first and part on the left edge of the
        second that stand side by side at some time join earlier than both are taken in
        (equal ranks: the leftmost pair goes first).
        """
        ok = self.pairs.get(before << self.BITS | token)
        if ok is None:
            left, _, rises2, whole2 = self._edges(token)
            _, right, rises, whole = self._edges(before) if before >= 0 else ((), (), True, True)
            if not (whole and whole2):
                ok = False
            elif rises and rises2:
                ok, rank = True, self.ranks.get
                for s, made, taken in right:
                    for p, made2, taken2 in left:
                        if made <= taken2 and made2 < taken and (r := rank(s + p)) is not None and r < taken and r <= taken2:
                            ok = False
            else:
                ok = self.merge(self.token[before] + self.token[token]) == [self.token[before], self.token[token]]
            self.pairs[before << self.BITS | token] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, int, tuple]:
        live, ends = [], []
        for node in self.nodes[state]:  # the longest first
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            if self.at[to] >= 0:
                ends.append((self.depth[to], self.at[to]))
            if self.inner[to]:
                live.append(to)
        if not ends:
            raise ValueError(f"no token ends at byte {byte}: the vocabulary lacks single bytes")
        key = (*live, 0)
        to = self.states.setdefault(key, len(self.nodes))
        if to == len(self.nodes):
            self.nodes.append(key)
        out = self.table[state << 8 | byte] = to, ends[-1][1], tuple(ends[:-1])
        return out

    def _chain(self, last: list[int], end: int) -> list[int]:
        """End positions on the token chain of the prefix of length ``end``."""
        out, size = [], self.size
        while end > 0:
            out.append(end)
            end -= size[last[end]]
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.nodes) + len(self.pairs) > self.max_states:
            self._reset()
        out, last, state, table, pairs = [], [-1], 0, self.table, self.pairs  # last[i]: token that ends at i
        for at in range(0, len(piece), BLOCK):
            if at:
                last = self._emit(out, last, state)
            add = last.append
            for end, byte in enumerate(piece[at:at + BLOCK], len(last)):
                state, t, longer = table.get(state << 8 | byte) or self._step(state, byte)
                for n, token in longer:  # if none of these, it is the shortest: one always is
                    before = last[end - n]
                    ok = pairs.get(before << 20 | token)
                    if ok is None:
                        ok = self.follows(before, token)
                    if ok:
                        t = token
                        break
                add(t)
        done, end, size = [], len(last) - 1, self.size
        while end > 0:
            t = last[end]
            done.append(t)
            end -= size[t]
        done.reverse()
        return out + done if out else done

    def _emit(self, out: list[int], last: list[int], state: int) -> list[int]:
        starts = [len(last) - 1 - self.depth[node] for node in self.nodes[state]]
        if min(starts) <= 0:
            return last
        common = set.intersection(*(set(self._chain(last, s)) for s in starts))
        if not common:
            return last
        sure = max(common)
        out.extend(last[e] for e in reversed(self._chain(last, sure)))
        return last[sure:]


def _utf8_table() -> tuple[bytes, bytes]:
    """Class of each byte, and the next state by (state, class), after the well-formed sequences of Unicode's table 3-7.

    States: 0 between characters; 1, 2, 3 so many continuation bytes to come; 4 to 7 as 2 or 3, but the next byte is
    limited (after E0, ED, F0, F4); 8 no such sequence.
    """
    groups = [(0x00, 0x7F), (0x80, 0x8F), (0x90, 0x9F), (0xA0, 0xBF), (0xC2, 0xDF), (0xE0, 0xE0), (0xE1, 0xEC), (0xED, 0xED),
              (0xEE, 0xEF), (0xF0, 0xF0), (0xF1, 0xF3), (0xF4, 0xF4)]
    kind = bytearray([len(groups)]) * 256
    for i, (a, b) in enumerate(groups):
        kind[a:b + 1] = bytes([i]) * (b + 1 - a)
    step = bytearray([8]) * (9 * 16)
    for group, to in ((0, 0), (4, 1), (5, 4), (6, 2), (7, 5), (8, 2), (9, 6), (10, 3), (11, 7)):
        step[group] = to
    for state, groups_, to in ((1, (1, 2, 3), 0), (2, (1, 2, 3), 1), (3, (1, 2, 3), 2), (4, (3,), 1), (5, (1, 2), 1), (6, (2, 3), 2), (7, (1,), 2)):
        for g in groups_:
            step[state * 16 + g] = to
    return bytes(kind), bytes(step)


class Utf8Machine:
    """Incremental UTF-8 by a state table: whole characters out, at most 3 bytes held back.

    What belongs to no character becomes U+FFFD, one for each longest beginning of a character.
    """

    KIND, STEP = _utf8_table()

    def __init__(self):
        self.state, self.held = 0, b""

    def feed(self, data: bytes, final: bool = False) -> str:
        out, kind, step, state, start = [], self.KIND, self.STEP, self.state, 0
        data, at = self.held + data, len(self.held)
        whole = 0  # up to here data is whole characters
        while at < len(data):
            to = step[state * 16 + kind[data[at]]]
            if to == 8:
                out.append(data[start:whole].decode())
                out.append("\ufffd")
                if state == 0:
                    at += 1
                start = whole = at  # the byte that broke a sequence may begin another
                state = 0
                continue
            at += 1
            state = to
            if state == 0:
                whole = at
        out.append(data[start:whole].decode())
        self.state, self.held = state, data[whole:]
        if final and self.held:
            out.append("\ufffd")
            self.state, self.held = 0, b""
        return "".join(out)


class Tokenizer:
    """Splits, encodes and decodes. Pieces of up to LONG_PIECE characters that were met before are kept in two
    generations of at most ``cache_pieces`` / 2, so what is frequent stays when the rest goes; most
    pieces are met once and never kept."""

    LONG_PIECE, SEEN = 40, 1 << 21
    WIDE = 16  # bytes of a token in the table of texts; longer ones go one by one

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_pieces: int = 300_000, max_states: int = 150_000):
        self.machine = Transducer(ranks, max_states)
        pattern = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}  # piece -> its ids as 32-bit numbers
        self.before: dict[str, bytes] = {}
        self.cache_pieces = cache_pieces
        self.seen, self.met = bytearray(self.SEEN), 0
        tokens = self.machine.token
        # decimal texts and a space, filled up with zero bytes; token bytes, filled up with FF, which UTF-8 doesn't have
        self.decimal = np.array([f"{i} ".encode() for i in range(len(tokens))], "S8").view("<u8")
        self.text = np.full((len(tokens), self.WIDE), 0xFF, np.uint8)
        self.whole = np.zeros(len(tokens), bool)
        for i, t in enumerate(tokens):
            m = Utf8Machine()
            if len(t) <= self.WIDE and m.feed(t).encode() == t and m.state == 0:
                self.text[i, :len(t)], self.whole[i] = np.frombuffer(t, np.uint8), True

    def _miss(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array("I", self.machine.encode(piece.encode())).tobytes()
            at = hash(piece) & self.SEEN - 1
            if not self.seen[at] or len(piece) > self.LONG_PIECE:
                self.seen[at] = 1
                self.met += 1
                if self.met > self.SEEN // 4:
                    self.seen, self.met = bytearray(self.SEEN), 0
                return ids
        if len(self.cache) >= self.cache_pieces // 2:
            self.before, self.cache = self.cache, {}
        self.cache[piece] = ids
        return ids

    def blocks(self, text: str):
        """Token ids block by block (an array), each with its decimal text."""
        if len(text) <= 1 << 20:
            pieces = iter(self.split.findall(text))
        else:
            pieces = (m[0] for m in self.split.finditer(text))
        miss = self._miss
        while part := list(itertools.islice(pieces, BLOCK)):
            get = self.cache.get
            ids = np.frombuffer(b"".join([get(p) or miss(p) for p in part]), np.uint32)
            yield ids, self.decimal[ids].tobytes().translate(None, b"\0")[:-1]

    def decode(self, ids: np.ndarray, machine: Utf8Machine, final: bool = False) -> bytes:
        """UTF-8 of the text that the machine emits for the next ids."""
        whole = self.whole[ids]
        if machine.state == 0 and whole.all():  # each token leads from state 0 to state 0
            out = self.text[ids].tobytes().translate(None, b"\xff")
        else:
            part, token = [], self.machine.token
            for t, w in zip(ids.tolist(), whole.tolist()):
                part.append(token[t] if w and machine.state == 0 else machine.feed(token[t]).encode())
            out = b"".join(part)
        return out + machine.feed(b"", final=True).encode() if final else out


def tokenizer_of(shared: dict) -> Tokenizer:
    """The tokenizer of a broadcast {ranks, pattern}: built once in each worker process and kept there."""
    if "built" not in shared:
        shared["built"] = Tokenizer(read_ranks(shared["ranks"]), shared["pattern"], shared["cache_pieces"], shared["max_states"])
    return shared["built"]


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, with_ids: bool = False, cache_pieces: int = 300_000, max_states: int = 150_000,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (decimal ids joined by one space),
    decoded_sha256 (bytes that the ids decode to), ``with_ids`` also ids.

    ``ranks`` is the content of a rank file (about 1 MB, broadcast). Null or empty text: no
    tokens, digests of the empty string. Repeated rows stay. Other columns are ignored.
    ``cache_pieces`` and ``max_states`` bound what a worker keeps (about 140 MB as given, 80 MB with 60,000 of each,
    for some 40 % more time); they change nothing in the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "pattern": pattern, "cache_pieces": cache_pieces, "max_states": max_states})

    def run(batches):
        tok = tokenizer_of(shared.value)
        for (doc_ids,), texts in text_groups(batches):
            rows = []
            for text in texts:
                n, ids, names, data, utf8, sep = 0, [], hashlib.sha256(), hashlib.sha256(), Utf8Machine(), b""
                for block, decimal in tok.blocks((text or b"").decode()):
                    n += len(block)
                    names.update(sep + decimal)
                    sep = b" "
                    data.update(tok.decode(block, utf8))
                    if with_ids:
                        ids.append(block)
                data.update(utf8.feed(b"", final=True).encode())
                rows.append((n, names.hexdigest(), data.hexdigest(), ids))
            cols = list(map(list, zip(*rows)))
            out = [pa.array(doc_ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *cols[0]], dtype=np.int32)
                flat = np.concatenate([np.zeros(0, np.uint32), *itertools.chain.from_iterable(cols[3])])
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
