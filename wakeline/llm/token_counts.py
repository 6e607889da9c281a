"""Token counts of a byte-level BPE tokenizer, by finite-state transducers.

Two deterministic machines are compiled from the tokenizer's file.

The splitter reads characters and marks where pieces end. It is a table of (state, class of the character); all texts of
a batch are cut into chunks of ``CHUNK`` characters that are read side by side. A chunk's state map tells for every
state at its start the state at its end; the maps are composed by a parallel prefix scan within each text, which gives
the true state at every chunk's start, and from it the ends of the pieces in it.

The counter reads the bytes of a piece; each of its transitions carries the change in the number of tokens. It rests on
two facts: every prefix of a piece has one encoding, and a row of tokens is an encoding exactly if each neighbouring pair
is one. So the last token of the next prefix follows from the last tokens of those shorter prefixes that a token can
still bridge, and these, with their counts relative to now, are the state. States and transitions are made when first
needed and kept, and so are the counts of pieces of up to ``SHORT`` bytes, by their hash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm._bytes import Rolling
from wakeline.llm._shared import texts

# White space in Unicode, as a regular expression class.
WHITE = r"\u0009-\u000d \u0085   -     　"

START, LETTERS, DIGITS, OTHERS, APOSTROPHE, ENDING, AP_R, AP_V, AP_L, BLANK, WHITE1, BLANKS, WHITES = range(13)
N_STATES = 13
#: One character of each class that the splitter tells apart; the last class is the filling of a chunk.
CLASSES = ("x", "1", "!", "\n", " ", "'", "s", "r", "v", "l", "e")
FILL = len(CLASSES)
WIDTH = FILL + 1
#: Characters of a chunk, and of the texts that are worked on at a time (one text at least).
CHUNK, PIECE_CHARS = 128, 1 << 20
#: Pieces of up to so many bytes are kept with their counts; entries after which a worker's tables are begun anew.
SHORT, KEPT_PIECES, KEPT_STATES = 64, 2_000_000, 250_000

_HASH = Rolling(31)


class Splitter:
    """Marks the ends of pieces."""

    def __init__(self) -> None:
        import regex

        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        every = points.astype(np.uint32).tobytes().decode("utf-32-le")
        self.of_char = np.full(0x110000, CLASSES.index("!"), np.uint8)
        for pattern, kind in ((r"\p{L}+", "x"), (r"\p{N}+", "1"), (f"[{WHITE}]+", "\n")):
            for m in regex.finditer(pattern, every):
                self.of_char[points[m.start() : m.end()]] = CLASSES.index(kind)
        for k, c in enumerate(CLASSES[4:]):
            for same in "stmd" if c == "s" else c:
                self.of_char[ord(same)] = k + 4
        # tables by state * WIDTH + class; next states are kept times WIDTH. ends: 1 before the character, 2 one earlier
        self.next = np.repeat(np.arange(N_STATES) * WIDTH, WIDTH)
        self.ends = np.zeros(N_STATES * WIDTH, np.uint8)
        for state in range(N_STATES):
            for k, c in enumerate(CLASSES):
                after, ends = self.step(state, c)
                self.next[state * WIDTH + k] = after * WIDTH
                self.ends[state * WIDTH + k] = (0 in ends) + 2 * (-1 in ends)

    @staticmethod
    def _begin(kind: str, c: str) -> int:
        if kind == "W":
            return BLANK if c == " " else WHITE1
        return APOSTROPHE if c == "'" else {"L": LETTERS, "N": DIGITS, "O": OTHERS}[kind]

    def step(self, state: int, c: str) -> tuple[int, tuple[int, ...]]:
        """(next state, ends) for a character of CLASSES: an end of 0 is before the character, one of -1 one earlier."""
        k = {"1": "N", "!": "O", "'": "O", "\n": "W", " ": "W"}.get(c, "L")
        if state == START:
            return self._begin(k, c), ()
        if k == {LETTERS: "L", DIGITS: "N", OTHERS: "O", APOSTROPHE: "O"}.get(state):
            return (OTHERS if state == APOSTROPHE else state), ()
        if state == APOSTROPHE and c == "s":
            return ENDING, ()
        if state == APOSTROPHE and c in ("r", "v", "l"):
            return {"r": AP_R, "v": AP_V, "l": AP_L}[c], ()
        if state in (AP_R, AP_V, AP_L):
            if c == ("l" if state == AP_L else "e"):
                return ENDING, ()
            after, ends = self.step(LETTERS, c)
            return after, (-1, *ends)
        if state in (BLANK, BLANKS, WHITE1, WHITES) and k == "W":
            return (BLANKS if c == " " else WHITES), ()
        if state in (BLANK, BLANKS):
            return {"L": LETTERS, "N": DIGITS, "O": OTHERS}[k], (-1,) if state == BLANKS else ()
        if state == WHITES:
            return self._begin(k, c), (-1, 0)
        return self._begin(k, c), (0,)

    def cuts(self, codes: np.ndarray, at: np.ndarray, chunk: int) -> np.ndarray:
        """Where pieces begin and end, in order, for the code points of texts that stand one after the other; at: where
        the texts begin, and the end of the last."""
        size = np.diff(at)
        n_chunks = -(-size // chunk)
        first = np.concatenate([[0], np.cumsum(n_chunks)])
        text = np.repeat(np.arange(len(size)), n_chunks)
        place = np.arange(first[-1]) - first[text]
        begin = at[text] + place * chunk
        kinds = np.full((len(text), chunk), FILL, np.uint8)
        kinds[np.arange(chunk) < (at[text + 1] - begin)[:, None]] = self.of_char[codes]
        kinds = np.ascontiguousarray(kinds.T)

        maps = np.repeat((np.arange(N_STATES) * WIDTH)[:, None], len(text), axis=1)
        for kind in kinds if place.any() else ():
            maps = self.next[maps + kind]
        reach = 1
        while reach <= place.max(initial=0):  # the scan: maps of 2, 4, 8 ... chunks, within each text
            i = np.flatnonzero(place >= reach)
            maps[:, i] = maps[maps[:, i - reach] // WIDTH, i]
            reach *= 2
        state = np.zeros(len(text), maps.dtype)
        state[1:] = np.where(place[1:] > 0, maps[START, :-1], START)

        marks = np.zeros(len(codes) + 2, bool)  # shifted by one
        for k, kind in enumerate(kinds):
            here = state + kind
            ends = self.ends[here]
            marks[begin[(ends & 1) > 0] + k + 1] = True
            marks[begin[(ends & 2) > 0] + k] = True
            state = self.next[here]
        last = first[1:][size > 0] - 1
        half_open = np.isin(state[last] // WIDTH, (AP_R, AP_V, AP_L))  # an ending that did not come to be
        marks[at[1:][size > 0][half_open]] = True
        marks[at + 1] = True
        return np.flatnonzero(marks[1:])


class Counter:
    """Counts the tokens of a piece, byte by byte."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in model["added_tokens"]]
        as_byte = _byte_symbols()
        raw = {token: bytes(as_byte[c] for c in token) for token in model["model"]["vocab"] if all(c in as_byte for c in token)}
        ids = {b: i for i, b in enumerate(sorted(set(raw.values())))}
        self.rank: dict[tuple[int, int], int] = {}
        self.time, self.parts = [-1] * len(ids), [None] * len(ids)
        for r, (a, b) in enumerate(model["model"]["merges"]):
            x, y = ids[raw[a]], ids[raw[b]]
            self.rank[x, y] = r
            whole = ids[raw[a] + raw[b]]
            if self.parts[whole] is None:
                self.time[whole], self.parts[whole] = r, (x, y)
        # the tree of tokens by bytes: node -> {byte: node}, and the token that ends at a node, if it is its own encoding
        self.down: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for b, i in ids.items():
            node = 0
            for byte in b:
                nxt = self.down[node].get(byte)
                if nxt is None:
                    nxt = self.down[node][byte] = len(self.down)
                    self.down.append({})
                    self.token.append(-1)
                node = nxt
            if len(b) == 1 or self.parts[i] is not None and self.neighbours(*self.parts[i], self.time[i]):
                self.token[node] = i
        self._pairs: dict[tuple[int, int], bool] = {}
        self._renew()

    def _renew(self) -> None:
        self._numbers = {((0, -1, 0),): 0}
        self._states = [((0, -1, 0),)]
        self.table: list[dict[int, tuple[int, int]]] = [{}]

    def neighbours(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether a and b stay apart up to merge number until. Merges are undone from the last one back; the tokens
        that meet at the border must never have been merged while they met."""
        while True:
            if self.rank.get((a, b), float("inf")) < until:
                return False
            ta, tb = self.time[a], self.time[b]
            if ta < 0 and tb < 0:
                return True
            if ta > tb:
                until, a = min(until, ta), self.parts[a][1]
            else:
                until, b = min(until, tb + 1), self.parts[b][0]

    def _new(self, state: int, byte: int) -> tuple[int, int]:
        open_, found = [], None
        for node, before, n in self._states[state]:
            node = self.down[node].get(byte)
            if node is None:
                continue
            if self.down[node]:
                open_.append((node, before, n))
            t = self.token[node]
            if t >= 0 and found is None:
                ok = before < 0
                if not ok:
                    ok = self._pairs.get((before, t))
                    if ok is None:
                        ok = self._pairs[before, t] = self.neighbours(before, t)
                if ok:
                    found = t, n + 1
        token, delta = found
        after = (*((x, y, n - delta) for x, y, n in open_), (0, token, 0))
        number = self._numbers.setdefault(after, len(self._states))
        if number == len(self._states):
            self._states.append(after)
            self.table.append({})
        self.table[state][byte] = number, delta
        return number, delta

    def piece(self, piece: bytes) -> int:
        if len(self._states) > KEPT_STATES:
            self._renew()
        n, state, table = 0, 0, self.table
        for byte in piece:
            move = table[state].get(byte) or self._new(state, byte)
            state = move[0]
            n += move[1]
        return n


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the
    others for the code points from 256 on in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizer:
    def __init__(self, path: str) -> None:
        self.splitter, self.counter = Splitter(), Counter(path)
        self._keys, self._counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between the strings of special tokens, and how many of these there are."""
        parts, n = [text], 0
        for s in self.counter.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
                n = len(parts) - 1
        return parts, n

    def _of_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece (bytes from starts to ends)."""
        raw, piece = data.tobytes(), self.counter.piece
        out = np.zeros(len(starts), np.int64)
        long = ends - starts > SHORT
        for k in np.flatnonzero(long):
            out[k] = piece(raw[starts[k] : ends[k]])
        short = np.flatnonzero(~long)
        number, names = pd.factorize(_HASH.runs(_HASH.prefix(_HASH.values[data]), starts[short], ends[short]))
        spot = np.searchsorted(self._keys, names)
        known = np.zeros(len(names), bool)
        inner = spot < len(self._keys)
        known[inner] = self._keys[spot[inner]] == names[inner]
        if not known.all():
            one = np.empty(len(names), np.int64)
            one[number[::-1]] = short[::-1]
            new = np.flatnonzero(~known)
            new = new[np.argsort(names[new])]
            counted = [piece(raw[starts[k] : ends[k]]) for k in one[new]]
            if len(self._keys) > KEPT_PIECES:
                old = np.sort(names[known])
                kept = np.searchsorted(self._keys, old)
                self._keys, self._counts = old, self._counts[kept]
            spot = np.searchsorted(self._keys, names[new])
            self._keys, self._counts = np.insert(self._keys, spot, names[new]), np.insert(self._counts, spot, counted)
        out[short] = self._counts[np.searchsorted(self._keys, names)][number]
        return out

    def counts(self, every: list[str], chunk: int = CHUNK) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(every), np.int64)
        owner, parts = [], []
        for i, text in enumerate(every):
            own, out[i] = self.segments(text)
            parts += own
            owner += [i] * len(own)
        joined = "".join(parts)
        if not joined:
            return out
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cuts = self.splitter.cuts(codes, at, chunk)
        bytes_at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF))])
        n = self._of_pieces(np.frombuffer(joined.encode(), np.uint8), bytes_at[cuts[:-1]], bytes_at[cuts[1:]])
        sums = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(cuts, at)]
        np.add.at(out, owner, np.diff(sums))
        return out


_made: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The machines for a tokenizer's file, one for each worker."""
    if path not in _made:
        _made[path] = Tokenizer(path)
    return _made[path]


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, chunk_chars: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    path: a byte-level BPE file of the tokenizers library, at the same place on every machine. No begin, end or added
    tokens are counted but those whose string is in the text, each as one token. A null text counts as empty, with no
    token. Rows with the same doc_id are counted each for itself; an empty table gives an empty result. One pass over
    the rows, without a shuffle; its memory is some 20 bytes for each character of the longest text.
    """
    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            every, n, i = b.column(2).to_pylist(), [], 0
            while i < len(every):
                j, size = i, 0
                while j < len(every) and (j == i or size + len(every[j]) <= PIECE_CHARS):
                    size += len(every[j])
                    j += 1
                n.append(t.counts(every[i:j], chunk_chars))
                i = j
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], ["doc_id", "n_bytes", "n_tokens"])

    counts = rows.select("doc_id", "n_bytes", "text").mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
