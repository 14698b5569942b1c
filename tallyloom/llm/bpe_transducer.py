"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly if every two
neighbours are: encoding the two together gives the two back.  So encodings form
a local language, and a transducer that guesses where tokens end accepts them:
its configurations are a node of the token trie, the token before it, and the
output still held back.  Determinised, a state is the set of live configurations;
what all of them agree on is emitted at once, and since a guess dies as soon as
its token can neither end nor go on, the lookahead is bounded by the token
lengths.  States and arcs are made when first met and remembered up to a limit,
which holds inside a piece too; beyond it the memory starts anew from the state
reached, with the same results.

Decoding runs an incremental UTF-8 state machine over token bytes, composed to
one arc per token, and hands text out as soon as it is complete.

Defined cases: a null text counts as empty, with no ids; bytes that are not
UTF-8 decode to the same bytes, and to U+FFFD in streamed text; repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_STATES = 200_000
MAX_PAIRS = 500_000
#: Pieces remembered, and the longest of them in characters; longer ones run through the machine each time.
MAX_PIECES, LONGEST_PIECE = 700_000, 64
MAX_DECODER_ARCS = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeRules:
    """What the ranks say about two neighbouring tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def by_merging(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The definition: join the neighbours of least rank, leftmost first, until none can join or few are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one last; None if its own bytes don't merge to it."""
        try:
            return self._halves[token]
        except KeyError:
            parts = self.by_merging(self.tokens[token], 2)
            made = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            return made

    def alone(self, token: int) -> bool:
        """Whether the token's own bytes merge to it."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def follow(self, first: int, second: int) -> bool:
        """Whether the two stand side by side in the encoding of their bytes.

        The merges of both are undone, latest first.  At each moment the parts
        that touch must not have a merge of their own before the one that took
        either away (an equal rank goes to the pair further left).
        """
        key = (first, second)
        if (known := self._pairs.get(key)) is not None:
            return known
        if len(self._pairs) >= MAX_PAIRS:
            self._pairs.clear()
        tokens, ranks, left, right = self.tokens, self.ranks, first, second
        left_taken = right_taken = 1 << 60
        known = True
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < left_taken and across <= right_taken:
                known = False
                break
            single = len(tokens[left]) == 1
            if single and len(tokens[right]) == 1:
                break
            if not single and (left > right or len(tokens[right]) == 1):
                left_taken, left = left, self.halves(left)[1]
            else:
                right_taken, right = right, self.halves(right)[0]
        self._pairs[key] = known
        return known


class Transducer:
    """Encodes one piece of text, byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rules = MergeRules(ranks)
        self.ranks = ranks
        # The trie: node -> (children by byte, token that ends there or -1); node 0 is the root.
        self._next: list[dict[int, int]] = [{}]
        self._ends: list[int] = [-1]
        for data, token in ranks.items():
            node = 0
            for byte in data:
                if byte not in self._next[node]:
                    self._next[node][byte] = len(self._next)
                    self._next.append({})
                    self._ends.append(-1)
                node = self._next[node][byte]
            self._ends[node] = token
        self._forget()

    def _forget(self, keep: tuple | None = None) -> int:
        """Start the memory anew with the first state and, if given, the one reached; returns the latter's number."""
        # A configuration: (trie node, token before it or -1, output held back).
        self._states: dict[tuple, int] = {}
        self._configs: list[tuple] = []
        self._final: list[tuple[int, ...] | None] = []
        self._arcs: dict[int, tuple[int, tuple[int, ...]]] = {}  # by 256 * state + byte
        start = self._state(((0, -1, ()),))
        return start if keep is None else self._state(keep)

    def _state(self, config: tuple) -> int:
        number = self._states.get(config)
        if number is None:
            number = self._states[config] = len(self._configs)
            self._configs.append(config)
            self._final.append(config[-1][2] if config[-1][0] == 0 else None)
        return number

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the arc: advance every configuration, drop the dead, emit what all agree on."""
        live, complete = [], None
        for node, before, held in self._configs[state]:
            node = self._next[node].get(byte)
            if node is None:
                continue
            token = self._ends[node]
            if complete is None and token >= 0 and self.rules.alone(token) and (before < 0 or self.rules.follow(before, token)):
                complete = (0, token, (*held, token))
            if self._next[node]:
                live.append((node, before, held))
        if complete is not None:
            live.append(complete)
        if not live:
            raise ValueError(f"the ranks have no token for byte {byte}")
        common = 0
        first = live[0][2]
        while common < len(first) and all(len(h) > common and h[common] == first[common] for _, _, h in live):
            common += 1
        emitted = first[:common]
        config = tuple((n, b, h[common:]) for n, b, h in live)
        if len(self._configs) >= MAX_STATES and config not in self._states:
            return self._forget(config), emitted  # the state it came from is gone, and so is the arc
        made = self._arcs[state << 8 | byte] = (self._state(config), emitted)
        return made

    def encode(self, piece: bytes) -> list[int]:
        # A piece that is a token of its own is that token even where its bytes would not merge to it.
        whole = self.ranks.get(piece)
        if whole is not None and not self.rules.alone(whole):
            return [whole]
        out: list[int] = []
        state = 0
        for byte in piece:
            arc = self._arcs.get(state << 8 | byte) or self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
        rest = self._final[state]
        if rest is None:
            raise ValueError("the bytes have no encoding under these ranks")
        out.extend(rest)
        return out


class Encoder:
    """Ids of whole texts: each match of the pattern through the transducer, frequent pieces remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self._find = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, run = self._known, self.transducer.encode
        pieces = self._find(text)
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        out = []
        for p in pieces:
            if (ids := known.get(p)) is None:
                ids = np.array(run(p.encode()), "<u4").tobytes()
                if len(p) <= LONGEST_PIECE:
                    if len(known) >= MAX_PIECES:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        return b"".join(out)


def _utf8_machine() -> list[list[int]]:
    """Arcs of the UTF-8 acceptor (RFC 3629): 0 between code points, 8 after an error."""
    ranges = {  # state: (from, to, next)
        0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 3), (0xE1, 0xEC, 2), (0xED, 0xED, 4), (0xEE, 0xEF, 2), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
        1: [(0x80, 0xBF, 0)],
        2: [(0x80, 0xBF, 1)],
        3: [(0xA0, 0xBF, 1)],
        4: [(0x80, 0x9F, 1)],
        5: [(0x90, 0xBF, 2)],
        6: [(0x80, 0xBF, 2)],
        7: [(0x80, 0x8F, 2)],
    }
    table = [[8] * 256 for _ in range(9)]
    for state, rows in ranges.items():
        for low, high, to in rows:
            table[state][low : high + 1] = [to] * (high - low + 1)
    return table


class StreamDecoder:
    """Text from ids as they come; an incomplete code point waits for its other bytes."""

    _machine = _utf8_machine()

    def __init__(self, tokens: dict[int, bytes]):
        self._tokens = tokens
        self._arcs: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self._held = b""

    def _arc(self, held: bytes, token: int) -> tuple[bytes, str]:
        """Compose the machine over one token: the bytes still held and the text that is complete."""
        data = held + self._tokens[token]
        text, begin, at, state = [], 0, 0, 0
        while at < len(data):
            to = self._machine[state][data[at]]
            if to == 8:  # replace what came, and read the byte again if it can begin a code point
                if state:
                    text.append("�")
                    begin, state = at, 0
                    continue
                text.append("�")
                begin = at + 1
            elif to == 0:
                text.append(data[begin : at + 1].decode())
                begin = at + 1
            state = 0 if to == 8 else to
            at += 1
        if len(self._arcs) >= MAX_DECODER_ARCS:
            self._arcs.clear()
        made = self._arcs[held, token] = (data[begin:], "".join(text))
        return made

    def feed(self, ids: Iterable[int]) -> str:
        out, held, arcs = [], self._held, self._arcs
        for token in ids:
            held, text = arcs.get((held, token)) or self._arc(held, token)
            if text:
                out.append(text)
        self._held = held
        return "".join(out)

    def finish(self) -> str:
        left, self._held = self._held, b""
        return "�" if left else ""


_ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=1)
def _machines(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """One pair a worker, whose memory outlives a task."""
    encoder = Encoder(load_ranks(path), pattern)
    return encoder, StreamDecoder(encoder.transducer.rules.tokens)


def _encode_rows(path: str, pattern: str, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _machines(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                packed = encoder.encode(text or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                back = decoder.feed(ids) + decoder.finish()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return encode


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids if asked for)."""
    return docs.select("doc_id", "text").mapInArrow(_encode_rows(ranks_path, pattern, with_ids), _ROWS + ", ids array<long>" * with_ids)
