"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags tokens as begin (B), inside (I) or outside (O) of a secret from token shape, neighbouring words and
features of the whole text, and is decoded by Viterbi over all tokens of each text (Decoder, exact). It is trained on
a bounded sample of windows, tagged by the fixed patterns, and on generated assignments.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ["assign", "access", "hex", "field"]

CONTEXT = 80
_TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+|[^\sA-Za-z0-9+/_.\-]")
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}")
_DIGIT = re.compile(r"[0-9]")
_HEX_ONLY = re.compile(r"[0-9a-f]+")
_CLASSES = str.maketrans(dict.fromkeys("0123456789", "9") | dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a") | dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"))
_KEYWORDS = {"password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "bearer", "credential", "credentials", "access", "private"}
B, I, O = range(3)  # noqa: E741

Span = tuple[int, int, int]  # start, kind number, end


def base_spans(text: str, kinds: Iterable[int] = (0, 1, 2)) -> list[Span]:
    found = []
    if 0 in kinds:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if 1 in kinds:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if 2 in kinds:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def candidate_windows(text: str) -> list[tuple[int, int]]:
    """Merged stretches of text around candidates, cut at white space where it is near."""
    windows: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        if _DIGIT.search(text, m.start(), m.end()):
            a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
            if a:
                a = next((k for k in range(a, max(-1, a - 200), -1) if text[k].isspace()), a)
            while b < len(text) and b - m.end() < CONTEXT + 200 and not text[b].isspace():
                b += 1
            if windows and a <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(b, windows[-1][1]))
            else:
                windows.append((a, b))
    return windows


def shape(token: str) -> str:
    out = []
    for c in token[:24]:
        k = "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c if c in "+/_.-=:\"'" else "s"
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:6])


def is_key(token: str) -> bool:
    w = token.lower().strip("._-")
    return w in _KEYWORDS or any(k in w for k in ("passw", "secret", "token", "key")) and len(w) < 24


def is_run(token: str) -> bool:
    return len(token) >= 12 and any(c.isdigit() for c in token)


def case_mix(token: str) -> int:
    return any(c.isdigit() for c in token) + any(c.islower() for c in token) + 2 * any(c.isupper() for c in token)


def text_features(runs: int, text_length: int) -> list[str]:
    return [f"runs{min(runs, 4)}", f"text{min(text_length.bit_length(), 16)}"]


def own_features(token: str) -> list[str]:
    """Feature names that need neither neighbours nor the text."""
    digits = sum(c.isdigit() for c in token)
    names = ["bias", f"shape {shape(token)}", f"size{min(len(token).bit_length(), 8)} mix{case_mix(token)}", f"digits{min(9, 10 * digits // max(1, len(token)))}", f"hex{_HEX_ONLY.fullmatch(token) is not None} size{min(len(token) // 4, 12)}"]
    if token.startswith("AKIA"):
        names.append("akia")
    if is_key(token):
        names.append("key")
    return names


def token_features(tokens: list[str], text_length: int, runs: int | None = None) -> list[list[str]]:
    """Feature names of each token; runs is the whole text's number of runs, where tokens are a part of it."""
    shapes = [shape(t) for t in tokens]
    key = [is_key(t) for t in tokens]
    file = text_features(sum(map(is_run, tokens)) if runs is None else runs, text_length)
    out = []
    for k, t in enumerate(tokens):
        digits, mix = any(c.isdigit() for c in t), case_mix(t)
        names = own_features(t)
        for d in (1, 2, 3):
            if k >= d:
                names.append(f"-{d} {shapes[k - d]}" if d < 3 else "-3")
                if key[k - d]:
                    names.append(f"-{d} key mix{mix}")
        if k + 1 < len(tokens):
            names.append(f"+1 {shapes[k + 1]}")
        names += [f"{f} long{len(t) >= 12} digit{digits}" for f in file]
        out.append(names)
    return out


@dataclass
class Field:
    """Weights of a linear chain over tags B, I, O."""

    names: dict[str, int]
    emit: np.ndarray  # a row for each feature
    step: np.ndarray  # from tag, to tag
    first: np.ndarray

    def scores(self, features: list[list[str]]) -> np.ndarray:
        return np.array([self.emit[[n for f in names if (n := self.names.get(f)) is not None]].sum(axis=0) for names in features]).reshape(-1, 3)

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi path."""
        return self.path(self.scores(features), self.first)

    def path(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> list[int]:
        scores, step = scores.tolist(), self.step.tolist()
        best, back = [a + b for a, b in zip(first.tolist(), scores[0], strict=True)], []
        for row in scores[1:]:
            ways = [[best[a] + step[a][b] for a in range(3)] for b in range(3)]
            back.append([max(range(3), key=w.__getitem__) for w in ways])
            best = [max(w) + s for w, s in zip(ways, row, strict=True)]
        if last is not None:
            best = [a + b for a, b in zip(best, last.tolist(), strict=True)]
        path = [max(range(3), key=best.__getitem__)]
        for choice in reversed(back):
            path.append(choice[path[-1]])
        return path[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        return Decoder(self).spans(text)


class Decoder:
    """The field's Viterbi path over all tokens of a text, without visiting each token in Python.

    A token's score is a sum of table rows of its type, its neighbours' types and the text. Against a path that is
    outside there, a token within a secret gains at most `most`: its better tag with the best step into it. The end of
    a secret may always be tagged outside instead, so on the best path each suffix of a secret gains at least 0, with
    `leave` for the step out that it takes against the one that it saves. Only tokens from which some stretch gains
    that much (by prefix sums) can be within a secret; each run of them is decoded between outside tokens, and the
    tokens between the runs are outside on the best path.
    """

    BLOCK, TYPES, SLACK = 1 << 16, 1 << 17, 1e-3

    def __init__(self, field: Field):
        self.field, self.types, self.alike = field, {}, {}
        self.rows, self.kinds = np.empty((1024, 12)), np.empty((1024, 3), np.int8)
        self.third = self.weight("-3")
        self.after_key = {d: np.array([self.weight(f"-{d} key mix{m}") for m in range(5)]) for d in (1, 2, 3)}
        step = field.step - field.step[O, O]
        self.into, self.leave = step.max(axis=0), np.ptp([0.0, step[B, O], step[I, O]])
        self.into_first = np.maximum(self.into, field.first - field.first[O])

    def weight(self, *names: str) -> np.ndarray:
        return self.field.emit[[n for f in names if (n := self.field.names.get(f)) is not None]].sum(axis=0)

    def type_of(self, token: str) -> int:
        """Row of the token's type: tokens of the same character classes share all features but three."""
        alike = token.translate(_CLASSES), _HEX_ONLY.fullmatch(token) is not None, token.startswith("AKIA"), is_key(token)
        k = self.alike.get(alike)
        if k is None:
            k = self.alike[alike] = len(self.alike)
            if k == len(self.rows):
                self.rows, self.kinds = np.concatenate([self.rows, np.empty_like(self.rows)]), np.concatenate([self.kinds, np.empty_like(self.kinds)])
            s = shape(token)
            self.rows[k] = np.concatenate([self.weight(*own_features(token)), self.weight(f"-1 {s}"), self.weight(f"-2 {s}"), self.weight(f"+1 {s}")])
            self.kinds[k] = 2 * (len(token) >= 12) + any(c.isdigit() for c in token), case_mix(token), is_key(token)
        self.types[token] = k
        return k

    def scores(self, tokens: list[str], text_length: int) -> np.ndarray:
        """Equal to field.scores(token_features(tokens, text_length)), but for rounding."""
        if len(self.types) > self.TYPES:
            self.types.clear()
            self.alike.clear()
        get = self.types.get
        ids = np.array([k if (k := get(t)) is not None else self.type_of(t) for t in tokens], np.int64)
        n, (size, mix, key) = len(ids), self.kinds[ids].T
        file = text_features(int((size == 3).sum()), text_length)
        of_text = np.array([self.weight(*(f"{f} long{x >= 2} digit{x % 2 == 1}" for f in file)) for x in range(4)])
        out = of_text[size]
        for a in range(0, n, self.BLOCK):
            b = min(n, a + self.BLOCK)
            rows = self.rows[ids[a:b]]
            out[a:b] += rows[:, :3]
            out[a + 1 : b + 1] += rows[: n - a - 1, 3:6]
            out[a + 2 : b + 2] += rows[: max(0, n - a - 2), 6:9]
            before = rows[1:, 9:] if a == 0 else rows[:, 9:]
            out[max(0, a - 1) : b - 1] += before
        out[3:] += self.third
        keys = np.flatnonzero(key)
        for d in (1, 2, 3):
            at = keys[keys + d < n] + d
            out[at] += self.after_key[d][mix[at]]
        return out

    def tags(self, tokens: list[str], text_length: int) -> Iterator[tuple[int, list[int]]]:
        """Start and tags of each run of tokens that may be within a secret."""
        if not tokens:
            return
        scores = self.scores(tokens, text_length)
        gains = scores - scores[:, O:]
        most = (gains + self.into)[:, :O].max(axis=1)
        most[0] = (gains[0] + self.into_first)[:O].max()
        sums = np.concatenate([[0.0], np.cumsum(most)])
        live = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1] >= -self.leave - self.SLACK
        edges = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]])))
        for a, b in edges.reshape(-1, 2).tolist():
            yield a, self.field.path(scores[a:b], self.field.step[O] if a else self.field.first, self.field.step[:, O] if b < len(tokens) else None)

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = _TOKEN.findall(text)
        found = []
        for a, tags in self.tags(tokens, len(text)):
            for k, tag in enumerate(tags):
                if tag == B:
                    end = k
                    while end + 1 < len(tags) and tags[end + 1] == I:
                        end += 1
                    found.append((a + k, a + end))
        if not found:
            return []
        at = [m.span() for m in _TOKEN.finditer(text)]
        return [(at[x][0], at[y][1]) for x, y in found]


def all_spans(text: str, decoder: Decoder, kinds: Iterable[int] = (0, 1, 2)) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the field's spans that touch none of them."""
    base = base_spans(text, kinds)
    added = [(a, 3, b) for a, b in decoder.spans(text) if not any(a < y and x < b for x, _, y in base)]
    return base, sorted(base + added)


class _Sequence:
    """A tagged sequence's features as one array: by token for the scores, by feature for the gradient."""

    def __init__(self, features: list[list[str]], tags: list[int], names: dict[str, int]):
        coded = np.array([names.setdefault(f, len(names)) for token in features for f in token])
        sizes = [len(token) for token in features]  # each token has a bias, so none is empty
        self.coded, self.starts = coded, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(coded, kind="stable")
        self.tokens = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.names, self.cuts = np.unique(coded[order], return_index=True)
        self.tags = np.array(tags)

    def scores(self, emit: np.ndarray) -> np.ndarray:
        return np.add.reduceat(emit[self.coded], self.starts, axis=0)

    def by_name(self, gradient: np.ndarray) -> np.ndarray:
        return np.add.reduceat(gradient[self.tokens], self.cuts, axis=0)


def _expected(scores: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each token's tags, and expected number of each step, by the forward-backward recursions on
    probabilities scaled at each token."""
    rows = np.exp(scores - scores.max(axis=1, keepdims=True))
    weights = np.exp(step)
    (bb, bi, bo), (ib, ii, io), (ob, oi, oo) = weights.tolist()
    b, i, o = (rows[0] * np.exp(first - first.max())).tolist()
    ahead, listed = [], rows.tolist()
    total = b + i + o
    b, i, o = b / total, i / total, o / total
    ahead.append((b, i, o))
    for x, y, z in listed[1:]:
        b, i, o = x * (b * bb + i * ib + o * ob), y * (b * bi + i * ii + o * oi), z * (b * bo + i * io + o * oo)
        total = b + i + o
        b, i, o = b / total, i / total, o / total
        ahead.append((b, i, o))
    behind = [(1.0, 1.0, 1.0)]
    b = i = o = 1.0
    for x, y, z in reversed(listed[1:]):
        b, i, o = x * b, y * i, z * o
        b, i, o = bb * b + bi * i + bo * o, ib * b + ii * i + io * o, ob * b + oi * i + oo * o
        total = b + i + o
        b, i, o = b / total, i / total, o / total
        behind.append((b, i, o))
    before, after = np.array(ahead), np.array(behind[::-1])
    chances = before * after
    chances /= chances.sum(axis=1, keepdims=True)
    pairs = before[:-1, :, None] * weights * (rows[1:] * after[1:])[:, None, :]
    return chances, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def train_field(sequences: list[tuple[list[list[str]], list[int]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> Field:
    """Maximum likelihood by adaptive gradient steps, one for each sequence."""
    names: dict[str, int] = {}
    coded = [_Sequence(features, tags, names) for features, tags in sequences]
    emit, step, first = np.zeros((len(names), 3)), np.zeros((3, 3)), np.zeros(3)
    first[I] = step[O, I] = -1e4  # inside only follows begin or inside
    seen_emit, seen_step, seen_first = np.full_like(emit, 1e-2), np.full_like(step, 1e-2), np.full_like(first, 1e-2)
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(coded)
        for s in coded:
            gradient, moves = _expected(s.scores(emit), step, first)
            gradient[np.arange(len(s.tags)), s.tags] -= 1
            np.subtract.at(moves, (s.tags[:-1], s.tags[1:]), 1)
            g = s.by_name(gradient) + decay * emit[s.names]
            seen_emit[s.names] += g * g
            emit[s.names] -= rate * g / np.sqrt(seen_emit[s.names])
            seen_step += moves * moves
            seen_first += gradient[0] ** 2
            step -= rate * moves / np.sqrt(seen_step)
            first -= rate * gradient[0] / np.sqrt(seen_first)
    return Field(names, emit, step, first)


def tagged(text: str, secrets: list[tuple[int, int]], length: int, runs: int | None = None) -> tuple[list[list[str]], list[int]]:
    at = [m.span() for m in _TOKEN.finditer(text)]
    owner = [next((n for n, (x, y) in enumerate(secrets) if s < y and x < e), -1) for s, e in at]
    tags = [O if n < 0 else I if k and owner[k - 1] == n else B for k, n in enumerate(owner)]
    return token_features([text[x:y] for x, y in at], length, runs), tags


def tagged_windows(text: str, length: int, runs: int | None = None) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Token features and tags, by the fixed patterns, of each candidate window; length and runs are the whole text's."""
    secrets = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    secrets += [(a, b) for a, k, b in base_spans(text, (1, 2)) if not any(a < y and x < b for x, y in secrets)]
    for a, b in candidate_windows(text):
        features, tags = tagged(text[a:b], [(x - a, y - a) for x, y in secrets], length, runs)
        if tags:
            yield features, tags


def generated_texts(n: int, seed: int = 3) -> list[str]:
    """Assignments of random keys among plain words, numbers and links."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    out = []
    for _ in range(n):
        left, right = (" ".join(word() for _ in range(r.randint(2, 8))) for _ in range(2))
        alphabet = r.choice(["0123456789abcdef", letters + letters.upper() + "0123456789", letters.upper() + "0123456789", letters + letters.upper() + "0123456789+/"])
        value = "".join(r.choice(alphabet) for _ in range(r.choice([18, 20, 24, 32, 40, 64])))
        quote = r.choice(["", '"', "'"])
        out.append(f"{left} {r.choice(['password', 'passwd', 'secret', 'token', 'api_key', 'apikey'])}{r.choice([' = ', '=', ': ', ':'])}{quote}{value}{quote} {right}")
        plain = [str(r.randint(10**15, 10**16)), f"{word()}.{r.randint(10, 99)}@{word()}{r.randint(1, 9)}.example.com", f"{word()}-{word()}-{r.randint(1000, 9999)}-{word()}", f"https://{word()}.example.com/{word()}/{r.randint(1000, 99999)}/{word()}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{word()}{r.randint(10, 99)}{word()}{word()}"]
        out.append(f"{left} {r.choice(plain)} {right}")
    return out


def generated_keywords(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with their secrets: short and digitless keys behind keywords that the fixed patterns lack, and the same
    keywords among plain words."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 12)))
    alphabets = ["0123456789", letters, letters.upper(), letters, letters.upper()]
    out = []
    for _ in range(n):
        key, sign = r.choice([("pwd", " = "), ("pwd", ": "), ("auth", " = "), ("auth", ": "), ("bearer", " "), ("Bearer", " "), ("credential", ": "), ("credentials", " = "), ("private_key", " = ")])
        parts = alphabets if r.random() < 0.7 else alphabets[1:]  # with digits, and without
        size = r.choice([8, 9, 10, 11, 12, 16, 20])
        value = ""
        while len(shape(value)) < 4:  # a capital word is no key
            value = "".join(r.choice(parts[k] if k < len(parts) else r.choice(parts)) for k in r.sample(range(size), size))
        left, right = (" ".join(r.choice([word(), word(), f"{word()}. {word().capitalize()}", f"{word()}. {word().capitalize()}."]) for _ in range(r.randint(1, 8))) for _ in range(2))
        text = f"{left} {key}{sign}"
        out.append((f"{text}{value} {right}", [(len(text), len(text) + len(value))]))
        plain = r.choice([word(), word().capitalize(), f"{word().capitalize()}.", word().upper(), str(r.randint(1, 10**9)), f"{word()}-{r.randint(1, 99)}", "the", f"{word()}."])
        out.append((f"{left} {key}{r.choice([' ', sign])}{plain} {right}", []))
    return out


def _sample_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(text[a:b], len(text), runs) for text in batch["text"].to_pylist() if (windows := candidate_windows(text)[:8]) for runs in [sum(map(is_run, _TOKEN.findall(text)))] for a, b in windows]
        window, length, runs = zip(*found, strict=True) if found else ([],) * 3
        yield pa.record_batch([pa.array(window, pa.string()), pa.array(length, pa.int64()), pa.array(runs, pa.int64())], ["window", "length", "runs"])


def fit_field(docs: DataFrame, sample_rows: int = 3000, windows: int = 600, generated: int = 100) -> Field:
    """Train on a bounded sample: of about sample_rows texts with a digit, chosen by a hash of the text, the first 8
    windows each, at most `windows` in all; and `generated` pairs of generated texts of either sort."""
    there = docs.count()
    dealt = F.pmod(F.xxhash64(F.col("text"), F.lit(23)), F.lit(1 << 30))
    near = docs.where((dealt < int((1 << 30) * min(1.0, 5 * sample_rows / max(1, there)))) & F.col("text").rlike("[0-9]")).select("text")
    found = near.mapInArrow(_sample_windows, "window string, length long, runs long").distinct().orderBy(F.xxhash64("window"), "window", "length", "runs").limit(windows).collect()
    texts = [tuple(r) for r in found] + [(t, len(t), None) for t in generated_texts(generated)]
    return train_field([x for t in texts for x in tagged_windows(*t)] + [tagged(t, secrets, len(t)) for t, secrets in generated_keywords(generated)])


def scan_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """Secrets of each document: counts and digest of the fixed patterns' spans, and all spans.

    spans lists kind:start:end (code points, end exclusive) by start, then by kind in the order of KINDS. A null text
    counts as empty and has none. Rows are scanned one by one; an empty table gives an empty result. Only doc_id
    and text are read.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            found = [all_spans(text, decoder, kinds) for text, kinds in _with_kinds(batch["text"])]
            bases = [digest(b) for b, _ in found]
            count = lambda k: pa.array([sum(x[1] == k for x in b) for b, _ in found], pa.int64())  # noqa: B023, E731
            yield pa.record_batch(
                [batch["doc_id"].cast(pa.int64()), count(0), count(1), count(2), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in bases]), pa.array([digest(s) for _, s in found])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _with_kinds(column: pa.Array) -> Iterator[tuple[str, list[int]]]:
    """Each text with the base kinds that may occur in it, by linear-time searches that only rule out."""
    texts = pc.fill_null(column, "")
    maybe = [pc.match_substring_regex(texts, p).to_pylist() for p in ("(?i)(passw|secret|token|api)[a-z_]*[\"']? *[:=]", "AKIA", "[0-9a-f]{32}")]
    for text, *flags in zip(texts.to_pylist(), *maybe, strict=True):
        yield text, [k for k in range(3) if flags[k]]


def redact_secrets(docs: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by mark, overlapping ones together; n_chars, where there, follows the text.

    All other columns and their order stay; a null text stays null.
    """
    names = docs.columns

    def scrub(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            texts = [_redacted(text, all_spans(text, decoder, kinds)[1], mark) for text, kinds in _with_kinds(batch["text"])]
            column = pc.if_else(batch["text"].is_valid(), pa.array(texts, pa.string()), None)
            at = names.index("text")
            arrays = [*batch.columns[:at], column.cast(batch.schema.field("text").type), *batch.columns[at + 1 :]]
            if "n_chars" in names:
                k = names.index("n_chars")
                changed = pc.not_equal(pc.fill_null(batch["text"], ""), pc.fill_null(arrays[at], ""))
                arrays[k] = pc.if_else(changed, pc.utf8_length(arrays[at]).cast(batch.schema.field("n_chars").type), arrays[k])
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(scrub, docs.schema)


def _redacted(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if merged else text


def secrets_query(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs, fit_field(docs))
