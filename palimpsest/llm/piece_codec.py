"""BPE encoding by a prefix table, and decoding, for a sentencepiece model.

For merge-type models the encoding of each prefix of a text has a unique last token. The table is filled from left to right:
an automaton gives the tokens that end at a place, and the one wanted is the one that is compatible with the last token of the
prefix before it, that is, merging the two tokens' text alone gives just these two. The ids are recovered backwards from the
last place. As no token has a space marker behind another character, the table is built for one word at a time. All unseen
words of some texts are done at once, one byte of each a round: their places in the automaton, the tokens that end there and
the outcomes of the pair tests are arrays. What is learnt is kept for words that come again (CACHE words, then it is emptied).

A pair test undoes the merges of both tokens from the last one back, along their merge trees: the pair is compatible unless
the two pieces that face each other could have merged before the merge just undone (of equal scores, the leftmost is first).
This needs trees in which every merge scores worse than those below it; other tokens are merged anew.

The model's normalizer must be the identity with a dummy prefix, as its file states; characters without a token become bytes.

Defined results: null text counts as empty; empty text has no ids and decodes to the empty text; a literal space marker
(U+2581) is a space, as for the library; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm._shared import ready

#: Words kept, pair tests kept, bytes of a word done beside others, bytes done at once, characters of text learnt at once.
CACHE, PAIRS, WIDTH, CELLS, TEXTS = 600_000, 1 << 21, 4096, 1 << 21, 4 << 20
SPACE, START, NONE, BYTE = "▁", -1, -(1 << 20), -3
_CHUNK = re.compile(" *[^ ]+| +")


class Automaton:
    """Aho-Corasick automaton over bytes: a full table of moves, and for each state the tokens that end there, longest first."""

    def __init__(self, tokens: dict[int, bytes]):
        child: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, raw in tokens.items():
            at = 0
            for b in raw:
                if b not in child[at]:
                    child[at][b] = len(child)
                    child.append({})
                at = child[at][b]
            ends[at] = i
        self.move = np.zeros((len(child), 256), dtype=np.int32)
        found: list[tuple[int, ...]] = [()] * len(child)
        level = [(0, 0)]  # state, its longest proper suffix that is a state
        while level:
            below = []
            for state, suffix in level:
                if state:
                    self.move[state] = self.move[suffix]
                    found[state] = ((ends[state],) if state in ends else ()) + found[suffix]
                for b, to in child[state].items():
                    below.append((to, int(self.move[suffix, b]) if state else 0))
                    self.move[state, b] = to
            level = below
        self.count = np.array([len(x) for x in found], dtype=np.int32)
        self.first = np.cumsum(self.count) - self.count
        self.token = np.array([i for x in found for i in x], dtype=np.int32)


class Outcomes:
    """Pair tests done so far: an open hash table from a pair's key to its outcome."""

    def __init__(self) -> None:
        self.clear()

    def clear(self, size: int = 1 << 16) -> None:
        self.keys, self.ok, self.n = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=bool), 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """For each key its slot, or the empty one where it belongs."""
        last = len(self.keys) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & last
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(left):
            at[left] = (at[left] + 1) & last
            slot = self.keys[at[left]]
            left = left[(slot != keys[left]) & (slot != -1)]
        return at

    def get(self, keys: np.ndarray, test) -> np.ndarray:  # noqa: ANN001
        """The outcome for each key; test(key) gives it for a new one."""
        at = self._place(keys)
        new = self.keys[at] == -1
        if new.any():
            todo = np.unique(keys[new])
            if 2 * (self.n + len(todo)) > len(self.keys):
                held, ok = self.keys[self.keys != -1], self.ok[self.keys != -1]
                size = 4 * (self.n + len(todo)) if self.n + len(todo) <= PAIRS else 4 * len(todo)
                self.clear(1 << max(16, (size - 1).bit_length()))
                if size > 4 * len(todo):
                    self._put(held, ok)
            self._put(todo, np.fromiter(map(test, todo.tolist()), bool, len(todo)))
            at = self._place(keys)
            if (lost := self.keys[at] != keys).any():  # emptied meanwhile
                self._put(again := np.unique(keys[lost]), np.fromiter(map(test, again.tolist()), bool, len(again)))
                at = self._place(keys)
        return self.ok[at]

    def _put(self, keys: np.ndarray, ok: np.ndarray) -> None:
        """Add keys that aren't there."""
        self.n += len(keys)
        while len(keys):
            at = self._place(keys)
            _, one = np.unique(at, return_index=True)  # of those that want one slot, one gets it
            self.keys[at[one]], self.ok[at[one]] = keys[one], ok[one]
            rest = np.ones(len(keys), dtype=bool)
            rest[one] = False
            keys, ok = keys[rest], ok[rest]


class PieceTable(dict):
    """Word without its first space -> its ids in decimal, joined by commas."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.piece = {i: sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.raw = {i: p.replace(SPACE, " ").encode() for i, p in self.piece.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.find = Automaton({i: p.encode() for i, p in self.piece.items()})
        self.size = np.zeros(n, dtype=np.int64)
        for i, p in self.piece.items():
            self.size[i] = len(p.encode())
        self.shift = n.bit_length()
        self.single = np.zeros(0x110000, dtype=bool)
        self.single[[ord(p) for p in self.id if len(p) == 1]] = True
        self.byte_id = np.array([self.byte[b] for b in range(256)], dtype=np.int32)
        self.text = list(map(str, range(n)))
        self.trees: dict[int, tuple[int, int, float] | None] = {}
        self.outcomes = Outcomes()
        self.said = Decoded(self)

    def merged(self, text: str) -> tuple[list[str], int]:
        """The tokens that merging gives: ever the adjacent pair of the best score, the leftmost of equals; and the size of the last merge's left part."""
        parts, left = list(text), 0
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts, left
            left = len(parts[at])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def tree(self, token: int) -> tuple[int, int, float] | None:
        """The parts of a token's last merge and its score (one character: itself twice, better than any); None if the trees don't serve."""
        if token not in self.trees:
            text, out = self.piece[token], None
            parts, left = self.merged(text)
            if len(text) == 1:
                out = (token, token, float("inf"))
            elif parts == [text] and text[:left] in self.id and text[left:] in self.id:
                a, b = self.tree(x := self.id[text[:left]]), self.tree(y := self.id[text[left:]])
                if a and b and min(a[2], b[2]) > self.score[text]:
                    out = (x, y, self.score[text])
            self.trees[token] = out
        return self.trees[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (START: a is no token that could merge with it)."""
        x, y = self.tree(a) if a != START else None, self.tree(b)
        if y is None or (x is None and a != START):
            left = self.piece.get(a, "")
            return self.merged(left + self.piece[b])[0] == [left] * bool(left) + [self.piece[b]]
        if x is None:
            return True
        score, piece, undone, tie = self.score, self.piece, float("-inf"), False
        while True:
            s = score.get(piece[a] + piece[b])
            if s is not None and (s > undone or (tie and s == undone)):
                return False
            if x[2] == y[2] == float("inf"):
                return True
            if tie := y[2] <= x[2]:  # the later merge is b's: pieces that face each other with its score lie to its left
                b, undone = y[0], y[2]
                y = self.tree(b)
            else:
                a, undone = x[1], x[2]
                x = self.tree(a)

    def _test(self, key: int) -> bool:
        return self.compatible((key >> self.shift) - 1, key & (1 << self.shift) - 1)

    def learn(self, words: Iterable[str]) -> None:
        """Add words, those of WIDTH bytes or fewer together, as many at once as fill CELLS bytes."""
        words = list(words)
        marked = [SPACE + w.replace(" ", SPACE) for w in words]
        size = np.array([len(m.encode("utf-8", "surrogatepass")) for m in marked], dtype=np.int64)
        order = np.argsort(size, kind="stable").tolist()
        at, end = 0, int(np.count_nonzero(size <= WIDTH))
        while at < end:
            to = at + 1
            while to < end and (to + 1 - at) * size[order[min(to + 255, end - 1)]] <= CELLS:
                to = min(to + 256, end)
            some = order[at:to]
            for i, (said, decoded) in zip(some, self.together([marked[i] for i in some]), strict=True):
                self[words[i]] = said
                self.said[said] = decoded
            at = to

    def together(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of each word in decimal, joined by commas, and what they decode to; words in order of their number of bytes."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array(list(map(len, raw)))
        width, first = int(size[-1]), np.cumsum(size) - size
        wide = np.array(raw, dtype=f"S{width}").view(np.uint8).reshape(-1, width)
        last = np.full((width + 1, len(words)), NONE, dtype=np.int32)
        last[0] = START
        # A byte of a character without a token is its own piece, written as BYTE less itself.
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        if (strange := ~self.single[chars]).any():
            n = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
            at = np.flatnonzero(np.repeat(strange, n))
            row = np.searchsorted(first, at, side="right") - 1
            last[at - first[row] + 1, row] = BYTE - wide[row, at - first[row]].astype(np.int32)
        state, find = np.zeros(len(words), dtype=np.int32), self.find
        for end in range(1, width + 1):
            begin = int(np.searchsorted(size, end))  # from here on words have this many bytes or more
            state = find.move[state[len(state) - (len(words) - begin) :], wide[begin:, end - 1]]
            left = np.flatnonzero((find.count[state] > 0) & (last[end, begin:] == NONE))
            k = 0
            while len(left):
                token = find.token[find.first[state[left]] + k]
                before = np.maximum(last[end - self.size[token], left + begin], START)
                ok = self.outcomes.get((before.astype(np.int64) + 1 << self.shift) + token, self._test)
                last[end, left[ok] + begin] = token[ok]
                k += 1
                left = left[~ok]
                left = left[find.count[state[left]] > k]
        # Backwards: one piece of each word a round.
        rows, at, back = np.arange(len(words)), size.copy(), []
        while len(rows):
            token = last[at, rows]
            back.append((rows, token))
            at = at - np.where(token >= 0, self.size[np.maximum(token, 0)], 1)
            rows, at = rows[at > 0], at[at > 0]
        row = np.concatenate([r for r, _ in back])[::-1]
        token = np.concatenate([t for _, t in back])[::-1]
        token = np.where(token >= 0, token, self.byte_id[np.clip(BYTE - token, 0, 255)])
        token = token[np.argsort(row, kind="stable")].tolist()
        said, decoded = [self.text[i] for i in token], [self.raw[i] for i in token]
        begin = 0
        for end in np.cumsum(np.bincount(row, minlength=len(words))).tolist():
            yield ",".join(said[begin:end]), b"".join(decoded[begin:end])
            begin = end

    def last_tokens(self, text: str) -> list[int | None]:
        """For each prefix of text its last token; START for the empty one and for a character without a token."""
        last: list[int | None] = [None] * (len(text) + 1)
        last[0] = START
        at = dict(zip(np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text]).tolist(), range(1, len(text) + 1), strict=True))
        for i, c in enumerate(text):
            if c not in self.id:
                last[i + 1] = START
        known: dict[tuple[int, int], bool] = {}
        find, state = self.find, 0
        for n, b in enumerate(text.encode("utf-8", "surrogatepass"), 1):
            state = int(find.move[state, b])
            for token in find.token[find.first[state] : find.first[state] + find.count[state]].tolist():
                end = at[n]
                before = last[end - len(self.piece[token])]
                if before is not None and last[end] is None:
                    if (before, token) not in known:
                        known[before, token] = self.compatible(before, token)
                    if known[before, token]:
                        last[end] = token
        return last

    def ids(self, text: str) -> list[int]:
        """The ids of a text in which spaces are markers, recovered backwards."""
        last, at, out = self.last_tokens(text), len(text), []
        while at:
            if (token := last[at]) == START:
                out += [self.byte[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                out.append(token)
                at -= len(self.piece[token])
        return out[::-1]

    def __missing__(self, word: str) -> str:
        return ",".join(map(str, self.ids(SPACE + word.replace(" ", SPACE))))

    def words(self, text: str) -> list[str]:
        """The words of a text, each without its first space."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            return [c[1:] for c in _CHUNK.findall(" " + text)]
        return text.split(" ")

    def encode_all(self, texts: list[str]) -> Iterator[list[str]]:
        """For each text the ids of its words, a string for each; words new to the table are learnt TEXTS characters at a time."""
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and size < TEXTS:
                held.append(self.words(texts[at]))
                size += len(texts[at])
                at += 1
            new: set[str] = set()
            for w in held:
                new.update(w)
            if len(self) >= CACHE:
                self.clear()
                self.said.clear()
            self.learn(new.difference(self))
            for w in held:
                yield [*map(self.__getitem__, w)]

    def encode(self, text: str) -> list[str]:
        """The ids of a text, a string of ids for each of its words."""
        return next(self.encode_all([text]))

    def decode(self, words: list[str]) -> str:
        """The text of ids, given as encode returns them; the dummy prefix goes."""
        return b"".join(map(self.said.__getitem__, words))[1:].decode("utf-8", "replace")


class Decoded(dict):
    """String of ids -> bytes."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.raw = table.raw

    def __missing__(self, said: str) -> bytes:
        out = b"".join(self.raw[int(i)] for i in said.split(","))
        if len(said) < 256:
            self[said] = out
        return out


_tables: dict[str, PieceTable] = {}


def table(path: str) -> PieceTable:
    """The worker's table for a model file."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            rows = []
            for words in t.encode_all([x or "" for x in b.column(1).to_pylist()]):
                ids = ",".join(words)
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(t.decode(words).encode("utf-8", "surrogatepass")).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def coded(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of documents (columns doc_id, text)."""
    ready(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_coded(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
