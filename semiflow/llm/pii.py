"""Personal data: exact patterns, and a linear-chain conditional random field over word-shape features.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field, trained on a small labelled table,
labels tokens (runs of other characters than blanks) and adds spans that the patterns miss, such as national phone
numbers, spelt-out addresses and access keys, where they overlap no span of a pattern. It is decoded by Viterbi over the
stretches of tokens within NEAR tokens of a digit, an @, or a (dot), an (at) or a bare "dot"; no other token can be
labelled, since every kind has one of them.

Null texts count as empty and have no spans; repeated rows are each scanned, rows with a null id too; an empty table
gives no rows; texts may have any length, and the patterns take time in proportion to it. Positions are code points,
ends exclusive. Other columns of the input are left out of reports and kept where texts are redacted.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semiflow.llm.common import small_batches

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NEAR = 3
TRIGGER = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]|(?<!\S)dot(?!\S)")
DIGIT = re.compile(r"[0-9]")
NUMERIC = re.compile(r"[0-9.]+")
#: What stands before and after the @ of an address.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Tokens whose scores a worker keeps, and the longest of them in characters.
KEPT, KEPT_LENGTH = 20_000, 48
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def email_spans(text: str) -> Iterator[Span]:
    """The leftmost address before each @ that a domain follows: its local part goes back to the last address or other character."""
    done, seen = 0, 0
    at = text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain and at >= done:
            before = text[max(done, seen) : at]
            if n := len(before) - len(before.rstrip(LOCAL)):
                done = domain.end()
                yield "email", at - n, done
        seen = at + 1
        at = text.find("@", seen)


def ip_spans(text: str, start: int) -> Iterator[Span]:
    """Four numbers with dots between them, from the left; of those, the ones with parts up to 255."""
    for run in NUMERIC.finditer(text, start):
        if run.group().count(".") < 3:
            continue
        numbers, at, i = run.group().split("."), run.start(), 0
        starts = []
        for x in numbers:
            starts.append(at)
            at += len(x) + 1
        while i + 3 < len(numbers):
            own = numbers[i : i + 4]
            if not all(own):
                i += 1
                continue
            if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in own):
                yield "ip", starts[i], starts[i + 3] + len(own[3])
            i += 4


def pattern_spans(text: str) -> list[Span]:
    """Leftmost matches that don't overlap, kind by kind; those that fail the kind's check are dropped."""
    out: list[Span] = list(email_spans(text))
    first = DIGIT.search(text)
    if first is None:
        return out
    out += ip_spans(text, first.start())
    for m in CARD.finditer(text, first.start()):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


# The field.

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words that speak for or against what stands beside them.
CUES = frozenset("at dot (at) (dot) [at] [dot] phone tel tel: call mobile fax card visa key token secret password api ip email mail version v page no number order id = := : licensed".split())


def shape(token: str, exact: bool = True) -> str:
    """X for upper case, x for lower, d for digits (each, or one for a run), other characters as they are."""
    s = re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_A-Z]", "x", re.sub(r"[A-Z]", "X", token)))
    s = re.sub(r"x+", "x", s)
    s = re.sub(r"X+", "X", s)
    return s[:40] if exact else re.sub(r"d+", "d", s)[:24]


def features(token: str) -> tuple[str, ...]:
    digits = sum(c in "0123456789" for c in token)
    low = token.lower()
    core = token.strip("\"'.,;:!?()<>[]{}")
    return (
        f"s={shape(token)}", f"c={shape(token, False)}", f"d={min(digits, 20)}", f"n={min(len(token), 48) // 4}",
        f"w={low if low in CUES else ''}",
        f"k={bool(re.fullmatch('[0-9a-f]{24,}', core))}{bool(re.fullmatch('(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]{16,}', core))}{bool(re.fullmatch('(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{20,}', core))}",
        f"@={'@' in token}",
    )


def named(tokens: list[str], i: int) -> list[str]:
    out = ["bias", *features(tokens[i])]
    out += [f"-{f}" for f in (features(tokens[i - 1]) if i else ("edge",))]
    return out + [f"+{f}" for f in (features(tokens[i + 1]) if i + 1 < len(tokens) else ("edge",))]


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def forbidden() -> np.ndarray:
    """-1e4 where an inside label would follow another kind."""
    bad = np.zeros((len(LABELS), len(LABELS)))
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            bad[[i for i, x in enumerate(LABELS) if x[2:] != to[2:] or x == "O"], j] = -1e4
    return bad


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best label sequences for emissions (sequences, length, labels) and transitions."""
    n, length, _ = e.shape
    score = e[:, 0] + np.where([x[0] == "I" for x in LABELS], -1e4, 0)
    back = np.zeros((n, length, len(LABELS)), np.int8)
    for i in range(1, length):
        s = score[:, :, None] + t[None]
        back[:, i] = s.argmax(1)
        score = s.max(1) + e[:, i]
    out = np.zeros((n, length), np.int64)
    out[:, -1] = score.argmax(1)
    for i in range(length - 1, 0, -1):
        out[:, i - 1] = back[np.arange(n), i, out[:, i]]
    return out


@dataclass
class Field:
    weights: dict[str, np.ndarray]
    moves: np.ndarray

    @classmethod
    def train(cls, rows: list[tuple[list[str], list[int]]], steps: int = 80, rate: float = 0.15, ridge: float = 0.02) -> Field:
        """rows: tokens and label numbers. Maximises the likelihood by Adam over forward and backward sums."""
        names: dict[str, int] = {}
        width = max(len(t) for t, _ in rows)
        n, k = len(rows), len(LABELS)
        cells = [[[names.setdefault(f, len(names)) for f in named(t, i)] for i in range(len(t))] for t, _ in rows]
        x = np.zeros((n, width, len(names)), np.float32)
        y, mask = np.zeros((n, width), int), np.zeros((n, width), bool)
        for r, (t, labels) in enumerate(rows):
            for i in range(len(t)):
                x[r, i, cells[r][i]] = 1
            y[r, : len(t)], mask[r, : len(t)] = labels, True
        flat, bad = x.reshape(n * width, -1), forbidden()
        gold = np.eye(k)[y] * mask[..., None]
        moved = np.zeros((k, k))
        for i in range(1, width):
            np.add.at(moved, (y[mask[:, i], i - 1], y[mask[:, i], i]), 1)
        first = np.where([s[0] == "I" for s in LABELS], -1e4, 0.0)
        w, t = np.zeros((len(names), k)), np.zeros((k, k))
        m = [np.zeros_like(w), np.zeros_like(t)]
        v = [np.zeros_like(w), np.zeros_like(t)]
        for step in range(1, steps + 1):
            e = (flat @ w.astype(np.float32)).reshape(n, width, k).astype(float)
            tt = t + bad
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0] + first
            for i in range(1, width):
                a[:, i] = np.where(mask[:, i, None], logsum(a[:, i - 1, :, None] + tt[None], 1) + e[:, i], a[:, i - 1])
            for i in range(width - 2, -1, -1):
                b[:, i] = np.where(mask[:, i + 1, None], logsum(tt[None] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
            z = logsum(a[:, -1], 1)
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            expect = np.zeros((k, k))
            for i in range(1, width):
                on = mask[:, i]
                expect += np.exp(a[on, i - 1, :, None] + tt[None] + (e[on, i] + b[on, i])[:, None, :] - z[on, None, None]).sum(0)
            g = [flat.T @ (p - gold).reshape(n * width, k).astype(np.float32) / n + ridge / n * w, (expect - moved) / n + ridge / n * t]
            for q, grad in enumerate(g):
                m[q] = 0.9 * m[q] + 0.1 * grad
                v[q] = 0.99 * v[q] + 0.01 * grad**2
                d = rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-8)
                if q:
                    t = t - d
                else:
                    w = w - d
        return cls({f: w[i] for f, i in names.items()}, t + bad)

    def emitter(self):
        """A function of a token: its own scores, and those that it lends to the next and the last token."""
        none = np.zeros(len(LABELS))

        def scores(token: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            f = features(token)
            return tuple(sum((self.weights.get(s + x, none) for x in f), none).astype(np.float32) for s in ("", "-", "+"))

        known = functools.lru_cache(KEPT)(scores)
        return lambda token: (known if len(token) <= KEPT_LENGTH else scores)(token)

    def labels(self, sequences: list[list[str]], of) -> list[np.ndarray]:
        """Best labels; sequences of like length are decoded together."""
        none = np.zeros(len(LABELS))
        bias, start, end = (self.weights.get(f, none) for f in ("bias", "-edge", "+edge"))
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            groups.setdefault(-(-len(s) // 8) * 8, []).append(i)
        for width, places in groups.items():
            for lo in range(0, len(places), max(1, 40_000 // width)):
                part = places[lo : lo + max(1, 40_000 // width)]
                e = np.zeros((len(part), width, len(LABELS)))
                e[:, :, 0] = 1e3
                for r, i in enumerate(part):
                    own = [of(t) for t in sequences[i]]
                    x = np.array([o[0] for o in own]) + bias
                    x[1:] += [o[1] for o in own[:-1]] if len(own) > 1 else np.zeros((0, len(LABELS)))
                    x[:-1] += [o[2] for o in own[1:]] if len(own) > 1 else np.zeros((0, len(LABELS)))
                    x[0] += start
                    x[-1] += end
                    e[r, : len(own)] = x
                best = viterbi(e, self.moves)
                for r, i in enumerate(part):
                    out[i] = best[r, : len(sequences[i])]
        return out


TOKEN = re.compile(r"\S+")
#: What goes before and after what a token means.
FRINGE = "\"'.,;:!?<>[]{}"


def labelled_table(rows: int = 300, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """A small labelled table made from patterns: tokens and label numbers."""
    rng = random.Random(seed)
    syllables = "an be co da el fi go ha in ka lo me no or pa que ra so ti un ver wa yo zu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n - 1)) + d(1)
    made = {
        "email": [lambda: f"{word()}.{d(2)}@{word()}.{word()}.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()} (at) {word()} (dot) com", lambda: f"{word()} [at] {word()} [dot] org", lambda: f"{word()}(at){word()}(dot)net", lambda: f"{word()} at {word()} dot com"],
        "ip": [lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}"],
        "card": [lambda: d(16), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"],
        "phone": [lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(2)} {d(3)} {d(7)}"],
        "secret": [lambda: f"AKIA{upper(16)}", lambda: f'"{hexed(40)}"', lambda: f"sk-{word()}{d(6)}{upper(12)}{word()}{d(3)}", lambda: f"ghp_{upper(18)}{hexed(18)}"],
    }
    lead = {"email": ["mail", "write to"], "ip": ["ip", "host"], "card": ["card", "visa"], "phone": ["phone", "call", "tel:"], "secret": ["token =", "key", "secret:"]}
    clean = [
        lambda: f"{rng.randint(1990, 2030)}-{d(2)}-{d(2)}", lambda: f"{rng.randint(1, 12)}:{d(2)}", lambda: f"version {rng.randint(1, 9)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(2)}",
        lambda: f"${d(3)}.{d(2)}", lambda: f"order {d(8)}", lambda: f"#{d(2)}", lambda: f"page {d(2)}", lambda: f"https://{word()}.org/{d(4)}/{d(2)}", lambda: f"{word()}{d(2)}",
        lambda: f"{d(2)}%", lambda: f"| {d(3)} | {d(2)} |", lambda: f"({rng.randint(1900, 2030)})", lambda: f"no {d(5)}", lambda: f"v{d(1)}.{d(1)}", lambda: f"BY-NC {d(1)}.0.", lambda: f"{d(1)},{d(3)}", lambda: f"{word()}@{word()}",
        lambda: f"{d(5)} {d(5)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{word()} (at {d(2)})", lambda: f"{d(1)}-{d(1)}", lambda: f"x={d(2)};", lambda: f"{d(12)}",
    ]
    out = []
    for i in range(rows):
        tokens: list[str] = []
        labels: list[int] = []

        def put(text: str, kind: str | None = None, tokens=tokens, labels=labels) -> None:
            for j, t in enumerate(text.split()):
                tokens.append(t)
                labels.append(0 if kind is None else LABELS.index(f"{'I' if j else 'B'}-{kind}"))

        def filler(put=put) -> None:
            for _ in range(rng.randint(1, 3)):
                w = word()
                put(w.capitalize() if rng.random() < 0.2 else w + rng.choice(["", "", "", ".", ",", "***", "$$$"]))

        filler()
        if i % 2:
            kind = KINDS[i // 2 % len(KINDS)]
            if rng.random() < 0.3:
                put(rng.choice(lead[kind]))
            put(rng.choice(made[kind])() + rng.choice(["", "", "", ".", ","]), kind)
        else:
            put(clean[i // 2 % len(clean)]())
        filler()
        out.append((tokens, labels))
    return out


@functools.lru_cache(1)
def default_field() -> Field:
    return Field.train(labelled_table())


def stretches(text: str) -> list[tuple[int, list[str], list[int]]]:
    """Tokens, with their starts, of each stretch that the field labels."""
    out: list[list] = []
    done = -1
    for hit in TRIGGER.finditer(text):
        if hit.start() < done:
            continue
        lo = hit.start()
        for _ in range(NEAR + 1):  # to the start of the token, then back over NEAR more
            while lo and text[lo - 1].isspace():
                lo -= 1
            while lo and not text[lo - 1].isspace():
                lo -= 1
        lo = max(lo, done if done > 0 else 0)
        hi, n = hit.start(), len(text)
        for _ in range(NEAR + 1):
            while hi < n and text[hi].isspace():
                hi += 1
            while hi < n and not text[hi].isspace():
                hi += 1
        if out and lo <= done:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
        # Further hits in the hit's own token add nothing; those after it may stretch on.
        done = hi
        # Stretch on while later tokens hold triggers.
        while (more := TRIGGER.search(text, max(hit.end(), _token_end(text, hit.start())), hi)) is not None:
            hit = more
            hi2 = more.start()
            for _ in range(NEAR + 1):
                while hi2 < n and text[hi2].isspace():
                    hi2 += 1
                while hi2 < n and not text[hi2].isspace():
                    hi2 += 1
            hi = max(hi, hi2)
            out[-1][1] = done = hi
    result = []
    for lo, hi in out:
        tokens = [(m.start(), m.group()) for m in TOKEN.finditer(text, lo, hi)]
        result.append((lo, [t for _, t in tokens], [a for a, _ in tokens]))
    return result


def _token_end(text: str, at: int) -> int:
    m = TOKEN.match(text, at)
    return m.end() if m else at + 1


#: An address, its signs perhaps spelt out.
SPELT = re.compile(r"[\w.+-]+\s*(?:@|[(\[]at[)\]]|\sat\s)\s*[\w-]+(?:\s*(?:\.|[(\[]dot[)\]]|\sdot\s)\s*[\w-]+)+", re.I)


def plausible(kind: str, s: str) -> bool:
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "email":
        return SPELT.fullmatch(s) is not None
    if kind == "ip":
        return 4 <= len(digits) <= 12 and s.count(".") == 3
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and sum(c.isalpha() for c in s) == 0
    return len(s) >= 16 and bool(digits) and any(c.isalpha() for c in s) and not any(c.isspace() for c in s)


def field_spans(tokens: list[str], starts: list[int], labels: np.ndarray) -> list[Span]:
    out: list[Span] = []
    i = 0
    while i < len(tokens):
        name = LABELS[labels[i]]
        if name[0] != "B":
            i += 1
            continue
        j = i + 1
        while j < len(tokens) and LABELS[labels[j]] == f"I-{name[2:]}":
            j += 1
        first, last = tokens[i], tokens[j - 1]
        fringe = FRINGE if name[2:] == "phone" else FRINGE + "()"
        if name[2:] == "email":
            fringe = FRINGE.replace("[", "").replace("]", "")
        a = starts[i] + len(first) - len(first.lstrip(fringe))
        b = starts[j - 1] + len(last.rstrip(fringe))
        if a < b:
            out.append((name[2:], a, b))
        i = j
    return out


def all_spans(texts: list[str], field: Field, of) -> list[tuple[list[Span], list[Span]]]:
    """For each text its pattern spans, and the spans that the field adds."""
    base = [pattern_spans(t) for t in texts]
    parts = [(i, tokens, starts) for i, t in enumerate(texts) for _, tokens, starts in stretches(t)]
    labels = field.labels([p[1] for p in parts], of)
    more: list[list[Span]] = [[] for _ in texts]
    for (i, tokens, starts), own in zip(parts, labels):
        if own.any():
            for s in field_spans(tokens, starts, own):
                if plausible(s[0], texts[i][s[1] : s[2]]) and all(s[2] <= a or b <= s[1] for _, a, b in base[i]):
                    more[i].append(s)
    return list(zip(base, more))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """A row for each document (doc_id, text): counts of pattern spans by kind, the digest of their list, all spans, and counts of all spans and of secrets."""
    field = field or default_field()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = field.emitter()
        names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_spans", "n_secret"]
        for x in batches:
            for lo in range(0, max(1, len(x)), 200):
                part = x.iloc[lo : lo + 200]
                got = all_spans([t or "" for t in part.text], field, of)
                rows = [
                    (i, *(sum(s[0] == k for s in base) for k in KINDS[:4]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(base) + len(more), sum(s[0] == "secret" for s in more))
                    for i, (base, more) in zip(part.doc_id, got)
                ]
                yield pd.DataFrame(rows, columns=names)

    return small_batches(docs).select("doc_id", "text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secret long")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [KIND] for each span; where spans overlap, one mark for all, of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(field: Field | None = None):
    """A column function: the text with a mark in place of each span; null stays null."""
    field = field or default_field()

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = field.emitter()
        for x in texts:
            out = []
            for lo in range(0, len(x), 200):
                part = list(x.iloc[lo : lo + 200])
                got = all_spans([t or "" for t in part], field, of)
                out += [None if t is None else redacted(t, base + more) if base or more else t for t, (base, more) in zip(part, got)]
            yield pd.Series(out, dtype=object)

    return clean


def redacted_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with a mark in place of each span of their text."""
    return small_batches(docs).withColumn("text", redact(field)(F.col("text")))
