"""Token counts by compiled finite-state transducers.

Two deterministic transducers replace the tokenizer:

* the splitter runs over character classes and marks where pre-tokens start. A text is cut into chunks; each
  chunk's state map (entry state -> exit state) is found for all chunks at once, the maps are composed through a
  parallel prefix scan, and with the entry states known the marks are emitted by all chunks at once.
* the counter runs over the UTF-8 bytes of a pre-token. A state holds, for every position from which a vocabulary
  entry may still be running, the last token of the merge result up to there; this is all that later bytes can
  depend on, so states are finite and transitions carry the change in the number of emitted tokens. States are
  made when first visited, in a table of bounded size, as a lazy automaton does, and all distinct pre-tokens of a
  batch advance together.

Only counts are produced, never token ids.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer
from tokenizers.normalizers import Normalizer
from tokenizers.pre_tokenizers import Split

from ._text import slices, text_bytes

CHUNK = 256
TABLE_CELLS = 1 << 24
CACHE_LIMIT = 400_000
END = 256  # symbol after a pre-token's last byte

#: The tokenizer file's contractions and byte alphabet.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


def byte_alphabet() -> list[str]:
    """Printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


POINTS = 0x110000
SURROGATES = range(0xD800, 0xE000)


@cache
def point_classes(patterns: tuple[str, ...]) -> np.ndarray:
    """Number of the pattern (from 1; 0 for none) that each code point matches, by the Unicode version of the tokenizer
    library."""
    runs, own = Split(Regex("|".join(f"{p}+" for p in patterns)), "isolated"), [Split(Regex(p), "removed") for p in patterns]
    found = np.zeros(POINTS, np.uint8)
    for low in range(0, POINTS, 4096):
        block = [c for c in range(low, low + 4096) if c not in SURROGATES]
        for piece, (a, b) in runs.pre_tokenize_str("".join(map(chr, block))) if block else ():
            found[block[a] : block[b - 1] + 1] = next((k for k, split in enumerate(own, 1) if not split.pre_tokenize_str(piece[0])), 0)
    return found


@cache
def newer_points() -> np.ndarray:
    """Whether Python's tables lack each code point; the library's may have it."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(POINTS)), bool, POINTS)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Splitter:
    """Transducer from character classes to pre-token starts."""

    SPACE, NUMBER, LETTER, OTHER, QUOTE = range(5)

    def __init__(self) -> None:
        tails = sorted({c for x in CONTRACTIONS for c in x[1:]})
        self.classes = 5 + len(tails)
        special = {c: 5 + k for k, c in enumerate(tails)}
        kinds = np.array([self.OTHER, self.LETTER, self.NUMBER, self.SPACE], np.uint8)[point_classes((r"\p{L}", r"\p{N}", r"\s"))]
        kinds[ord("'")] = self.QUOTE
        for c, k in special.items():
            kinds[ord(c)] = k
        self.kinds = kinds
        # States: 0 outside a pre-token, 1 in letters, 2 in other signs, then one for each proper prefix of a
        # contraction at a pre-token's start.
        prefixes = sorted({x[:k] for x in CONTRACTIONS for k in range(1, len(x))})
        number = {p: 3 + k for k, p in enumerate(prefixes)}
        self.states = 3 + len(prefixes)
        step = np.zeros((self.states, self.classes), np.uint8)
        emit = np.zeros((self.states, self.classes), np.uint8)  # 1: a start here; 2: a start one character before
        sign = {5 + k: c for k, c in enumerate(tails)}
        fresh = {self.SPACE: (0, 0), self.NUMBER: (0, 1), self.LETTER: (1, 1), self.OTHER: (2, 1), self.QUOTE: (number["'"], 1)} | {k: (1, 1) for k in sign}
        for kind in range(self.classes):
            letter, other = kind == self.LETTER or kind in sign, kind in (self.OTHER, self.QUOTE)
            step[0, kind], emit[0, kind] = fresh[kind]
            step[1, kind], emit[1, kind] = (1, 0) if letter else fresh[kind]
            step[2, kind], emit[2, kind] = (2, 0) if other else fresh[kind]
            for p, state in number.items():
                longer = p + sign.get(kind, "?")
                if longer in CONTRACTIONS:
                    step[state, kind], emit[state, kind] = 0, 0
                elif longer in number:
                    step[state, kind], emit[state, kind] = number[longer], 0
                elif p == "'":  # the quote was an ordinary sign
                    step[state, kind], emit[state, kind] = (2, 0) if other else fresh[kind]
                else:  # so was this one, and a letter run began after it
                    then, mark = (1, 0) if letter else fresh[kind]
                    step[state, kind], emit[state, kind] = then, mark | 2
        self.step, self.emit = step.reshape(-1), emit.reshape(-1)

    def entry_states(self, kinds: np.ndarray) -> np.ndarray:
        """Entry state of each chunk; kinds has a row for each position and a column for each chunk."""
        depth, lanes = kinds.shape
        maps = np.repeat(np.arange(self.states, dtype=np.uint8)[:, None], lanes, axis=1)
        open_lanes, p = np.arange(lanes), 0
        settled = np.zeros(lanes, np.uint8)
        settled_from = np.full(lanes, depth)
        while p < depth and len(open_lanes):
            stop = min(p + 16, depth)
            part = maps[:, open_lanes]
            for q in range(p, stop):
                part = self.step[part * np.uint8(self.classes) + kinds[q, open_lanes]]
            maps[:, open_lanes] = part
            same = (part == part[0]).all(axis=0)
            done = open_lanes[same]
            settled[done], settled_from[done] = part[0, same], stop
            open_lanes, p = open_lanes[~same], stop
        constant = settled_from < depth
        state = settled.copy()
        for q in range(0, depth, 16):  # settled chunks: one state instead of a map
            live = np.flatnonzero(settled_from <= q)
            if len(live) == lanes:
                live = slice(None)
            part = state[live]
            for r in range(q, min(q + 16, depth)):
                part = self.step[part * np.uint8(self.classes) + kinds[r, live]]
            state[live] = part
        maps[:, constant] = state[constant]
        scan, d = np.ascontiguousarray(maps.T), 1
        while d < lanes:  # inclusive parallel prefix scan: later map after earlier map
            scan[d:] = np.take_along_axis(scan[d:], scan[:-d], axis=1)
            d *= 2
        return np.concatenate([np.zeros(1, np.uint8), scan[:-1, 0]])

    def pretokens(self, text: str) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of a text and where each starts."""
        points = code_points(text)
        n = len(points)
        lanes = -(-n // CHUNK)
        kinds = np.full(lanes * CHUNK, self.SPACE, np.uint8)
        kinds[:n] = self.kinds[points]
        grid = np.ascontiguousarray(kinds.reshape(lanes, CHUNK).T)
        state = self.entry_states(grid)
        marks = np.empty_like(grid)
        for q in range(CHUNK):
            at = state * np.uint8(self.classes) + grid[q]
            marks[q] = self.emit[at]
            state = self.step[at]
        flat = np.ascontiguousarray(marks.T).reshape(-1)
        starts = (flat & 1).astype(bool)
        starts[:-1] |= (flat[1:] & 2).astype(bool)
        at = np.flatnonzero(starts | (kinds == self.SPACE))
        ends = np.append(at[1:], lanes * CHUNK)
        chosen = starts[at]
        at, ends = at[chosen], ends[chosen]
        return list(map(text.__getitem__, map(slice, at.tolist(), ends.tolist()))), at


class Counter:
    """Lazily determinised transducer from a pre-token's bytes to its number of tokens."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str) -> None:
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}

        def raw(piece: str) -> tuple[bytes, bool]:
            last = piece.endswith(suffix)
            return bytes(back[c] for c in (piece[: -len(suffix)] if last else piece)), last

        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        single = {(bytes([b]), last) for b in range(256) for last in (False, True)}
        made = {(a[0] + b[0], b[1]) for a, b in self.rank}
        self.vocabulary = {x for x in single | made}
        self.running = {x[:k] for x, _ in self.vocabulary for k in range(1, len(x))} | {x for x, last in self.vocabulary if last}
        self.pairs: dict = {}
        self.reset()

    def reset(self) -> None:
        start = ((b"", None, 0),)
        self.numbers, self.held = {start: 1}, [None, start]
        self.width = 64  # columns; a symbol gets one when it first occurs
        self.column = np.full(257, -1, np.int64)
        self.symbols: list[int] = []
        self.next = np.zeros(TABLE_CELLS, np.int32)
        self.change = np.zeros(TABLE_CELLS, np.int16)

    def columns(self, symbols: np.ndarray) -> None:
        """Give columns to new symbols; a table that needs wider rows starts anew."""
        for symbol in np.flatnonzero(np.bincount(symbols, minlength=257) * (self.column < 0)).tolist():
            if len(self.symbols) == self.width:
                width = min(257, 2 * self.width)
                self.reset()
                self.width = width
                return self.columns(symbols)
            self.column[symbol] = len(self.symbols)
            self.symbols.append(symbol)

    def merged(self, symbols: list) -> list:
        """Merge by rank, leftmost first."""
        while len(symbols) > 1:
            best = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            k = best[1]
            symbols[k : k + 2] = [(symbols[k][0] + symbols[k + 1][0], symbols[k + 1][1])]
        return symbols

    def follows(self, before: bytes | None, piece: bytes, last: bool) -> bool:
        """Whether the piece stays a token of its own right after the token `before`."""
        key = (before, piece, last)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > CACHE_LIMIT:
                self.pairs.clear()
            whole = (before or b"") + piece
            got = self.merged([(whole[k : k + 1], last and k == len(whole) - 1) for k in range(len(whole))])
            known = self.pairs[key] = got == ([(before, False)] if before is not None else []) + [(piece, last)]
        return known

    def advance(self, held: tuple, symbol: int) -> tuple[tuple | None, int]:
        """Next state and the change of the count; after END only the count matters."""
        if symbol == END:
            for piece, before, count in held:
                if piece and (piece, True) in self.vocabulary and self.follows(before, piece, True):
                    return None, count + 1
            raise ValueError("no tokens for a pre-token")
        byte, kept, found = bytes([symbol]), [], None
        for piece, before, count in held:
            longer = piece + byte
            if found is None and (longer, False) in self.vocabulary and self.follows(before, longer, False):
                found = (longer, count + 1)
            if longer in self.running:
                kept.append((longer, before, count))
        token, change = found
        return (*((p, b, c - change) for p, b, c in kept), (b"", token, 0)), change

    def number(self, held: tuple) -> int:
        k = self.numbers.get(held)
        if k is None:
            if len(self.held) >= TABLE_CELLS // self.width:
                raise OverflowError
            k = self.numbers[held] = len(self.held)
            self.held.append(held)
        return k

    def alone(self, word: bytes) -> int:
        held, total = self.held[1], 0
        for b in word:
            held, change = self.advance(held, b)
            total += change
        return total + self.advance(held, END)[1]

    def together(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, all words advancing in step through the transition table."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = np.frombuffer(b"".join(words[k] for k in order.tolist()), np.uint8)
        self.columns(np.append(data, END))
        width = self.width
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        state = np.ones(len(words), np.int32)
        total = np.zeros(len(words), np.int64)
        for p in range(int(size[0]) + 1 if len(size) else 0):
            live = int(np.searchsorted(-size, -p, "right"))  # words of at least p bytes
            going = int(np.searchsorted(-size, -p, "left"))  # words of more than p bytes
            symbol = np.full(live, END, np.int64)
            symbol[:going] = data[begin[:going] + p]
            at = state[:live].astype(np.int64) * width + self.column[symbol]
            then = self.next[at]
            if not then.all():
                for key in np.unique(at[then == 0]).tolist():
                    held, change = self.advance(self.held[key // width], self.symbols[key % width])
                    self.change[key] = change
                    self.next[key] = 1 if held is None else self.number(held)
                then = self.next[at]
            total[:live] += self.change[at]
            state[:live] = then
        result = np.empty(len(words), np.int64)
        result[order] = total
        return result

    def counts(self, words: list[bytes]) -> np.ndarray:
        for _ in range(2):
            try:
                return self.together(words)
            except OverflowError:
                self.reset()
        if len(words) == 1:
            return np.array([self.alone(words[0])])
        half = len(words) // 2
        return np.concatenate([self.counts(words[:half]), self.counts(words[half:])])


class TokenCounter:
    """Counts the tokens of whole texts as the tokenizer file's library does."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix"):
            raise ValueError("only a BPE with a word-end suffix can be compiled")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.path, self.library = path, None
        self.splitter = Splitter()
        self.counter = Counter([tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in spec["model"]["merges"]], spec["model"]["end_of_word_suffix"])
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        for token in self.special:
            for k, text in enumerate(texts):
                if token in text:
                    extra[k] += text.count(token)
                    texts[k] = text = text.replace(token, "\n")
        joined = "\n".join(texts)
        if not joined.isascii():
            newer = newer_points()[code_points(joined)].any()
            texts = [self.normal(x, newer) for x in texts]
            joined = "\n".join(texts)
        else:
            joined = joined.lower()  # as many characters as before
        words, starts = self.splitter.pretokens(joined)
        bounds = np.cumsum([len(x) + 1 for x in texts])
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            missing = list({w for w, n in zip(words, found, strict=True) if n is None})
            if len(known) + len(missing) > CACHE_LIMIT:
                known.clear()
                missing = list(set(words))
            for k in range(0, len(missing), 20_000):
                part = missing[k : k + 20_000]
                known.update(zip(part, self.counter.counts([w.encode("utf-8", "surrogatepass") for w in part]).tolist(), strict=True))
            found = list(map(known.__getitem__, words))
        sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64))])
        return np.diff(sums[np.searchsorted(starts, bounds)], prepend=0) + extra

    def normal(self, text: str, newer: bool) -> str:
        """Composed and in lower case; newer: it may hold characters that Python's tables lack."""
        if text.isascii():
            return text.lower()
        if newer and newer_points()[code_points(text)].any():
            return self.normalizer.normalize_str(text)
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letters are lowered one by one, without the final form

    @property
    def normalizer(self) -> Normalizer:
        if self.library is None:
            self.library = Tokenizer.from_file(self.path).normalizer
        return self.library


_COUNTERS: dict[str, TokenCounter] = {}


def counter_of(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """UTF-8 bytes and tokens of each document, and whether it has more than `limit` tokens.

    tokenizer is the path of a BPE file with a word-end suffix, present on every executor. A null text counts as
    empty: no bytes, no tokens. Rows are counted one by one, so repeated rows repeat; an empty table gives an
    empty result. Only doc_id and text are read; doc_id may be null.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter_of(tokenizer)
        for batch in batches:
            _, offsets = text_bytes(batch["text"])
            texts = pc.fill_null(batch["text"], "")
            for i, j in slices(offsets, 1 << 20):
                tokens = machine.counts(texts[i:j].to_pylist())
                yield pa.record_batch([batch["doc_id"][i:j].cast(pa.int64()), pa.array(np.diff(offsets[i : j + 1])), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
