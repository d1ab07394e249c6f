"""Personal data: fixed patterns, and a conditional random field that adds spans which these miss.

Tokens are runs of what is not white space. As all kinds sought here hold a digit or an @, tokens with neither are
always outside; a line falls into runs of the other tokens, and the field labels each run, given the shapes of its
tokens and their neighbours. It is trained on a small labelled table (`labelled_table`, or one's own) and decoded by
Viterbi in numpy batches. Its spans lose outer punctuation, must not overlap those of the patterns, and must pass the
kind's check of digits.

Defined cases: a null text is an empty one without spans (`redacted` keeps it null); repeated rows and rows without an id
get a result each; an empty table gives none; a very long text takes memory for its own spans and tokens; of overlapping
spans the first is redacted, of those at one place that of the first kind; further columns are ignored (by `spans`) or
kept (by `redacted`, which sets a column n_chars anew).
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import BUCKETS, Crf
from .storage import tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[int, int, str]  # start, end, kind

# Fixed patterns. Possessive or anchored where that changes no match, so that long runs take linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by start, then kind in the order of KINDS."""
    found: list[Span] = []
    free = 0  # where the last address ended
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGITS.findall(m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


TOKEN = re.compile(r"[0-9@]\S*")
WORD = re.compile(r"\S+")


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens with a digit or an @, as (start, end) of each."""
    out: list[list[tuple[int, int]]] = []
    end = 0
    for m in TOKEN.finditer(text):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        if out and not (gap := text[end:start]).strip() and "\n" not in gap and len(gap) <= 2:
            out[-1].append((start, m.end()))
        else:
            out.append([(start, m.end())])
        end = m.end()
    return out


@lru_cache(1 << 14)
def shape(token: str) -> tuple[int, ...]:
    """Hashed features of a token by itself."""
    token = token if len(token) <= 64 else token[:48] + token[-16:]
    full = re.sub("[^\x00-\x7f]", "x", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", token))))
    short = re.sub(r"(.)\1+", r"\1+", full)
    n = len(DIGITS.findall(token))
    core = full.strip(".,;:!?()[]<>\"'{}*%#$&|")
    words = (f"s{short}", f"f{full[:24]}", f"c{core[:24]}", f"n{min(n, 20)}", f"p{short[:3]}", f"e{short[-3:]}", f"at{'@' in token}{'.' in token.partition('@')[2]}", f"d{full.count('.')}{full.count('-')}")
    return tuple(zlib.crc32(w.encode()) % BUCKETS for w in words)


@lru_cache(1 << 14)
def beside(token: str, side: str) -> tuple[int, ...]:
    """Hashed features of a neighbour: its collapsed shape, its length, and itself if short."""
    short = re.sub(r"(.)\1+", r"\1+", re.sub("[^\x00-\x7fA-Za-z]", "x", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", token[:64])))))
    digits = re.sub("[0-9]", "0", token)[:16]
    return tuple(zlib.crc32(f"{side}{w}".encode()) % BUCKETS for w in (f"s{short}", f"f{digits if any(c.isdigit() for c in token) else short}"))


WIDTH = 12


def features(text: str, run: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """WIDTH features for each token of a run."""
    tokens = [text[a:b] for a, b in run]
    before = WORD.findall(text[max(0, run[0][0] - 24) : run[0][0]])
    after = WORD.search(text, run[-1][1], run[-1][1] + 24)
    around = [before[-1] if before else "", *tokens, after[0] if after else ""]
    return [shape(t) + beside(around[i], "<") + beside(around[i + 2], ">") for i, t in enumerate(tokens)]


def padded(rows: list[list[tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.full((len(rows), int(lengths.max()), WIDTH), -1)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def labelled_table(n: int = 700, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts and their spans: formats of the four kinds, and numbers that are none of them."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "in", "que", "ung", "la", "th", "re", "os")) for _ in range(r.randint(1, 4)))

    def card() -> str:
        d = r.choice("3456") + digits(r.choice((14, 14, 14, 13, 15)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    area = lambda: f"{r.randint(200, 989)}"
    phones = (
        lambda: f"+{r.randint(1, 99)} ({area()}) 555-{digits(4)}",
        lambda: f"({area()}) {digits(3)}-{digits(4)}",
        lambda: f"{area()}-{digits(3)}-{digits(4)}",
        lambda: f"{area()}.{digits(3)}.{digits(4)}",
        lambda: f"+{r.randint(20, 60)} {digits(2)} {digits(4)} {digits(4)}",
        lambda: f"+{r.randint(20, 60)}{digits(10)}",
        lambda: f"00{r.randint(20, 60)} {digits(2)} {digits(7)}",
    )
    part = lambda: str(r.randint(0, 255))
    makers = {
        "email": lambda: r.choice((word(), digits(2), f"{word()}.{word()}{digits(2)}", f"{word()}+{word()}")) + "@" + r.choice(("mail", word())) + digits(1) + "." + r.choice(("example.com", "example.org", word() + ".net")),
        "ip": lambda: ".".join(part() for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice(phones)(),
    }
    nothing = (
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}",
        lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        lambda: str(r.randint(1900, 2030)),
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}",
        lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02d}",
        lambda: f"${r.randint(1, 999)},{digits(3)}.00",
        lambda: f"{r.randint(1, 99)}%",
        lambda: f"0.{digits(6)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        lambda: f'key = "{"".join(r.choice("0123456789abcdefABCDEF") for _ in range(32))}"',
        lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)),
        lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"@{word()}",
        lambda: " ".join(digits(r.randint(1, 5)) for _ in range(r.randint(2, 7))),
        lambda: f"{r.randint(1, 9)},{digits(3)},{digits(3)}",
        lambda: f"#{digits(r.randint(1, 6))}",
        lambda: digits(r.randint(5, 12)),
        lambda: f"{word()}{digits(2)} | {digits(3)} | {digits(2)}",
        lambda: f"{r.randint(1, 99)}-{r.randint(100, 199)}",
    )
    out = []
    for i in range(n):
        text, spans = word().capitalize(), []
        for _ in range(r.randint(1, 3)):
            text += r.choice((" ", " ", f" {word()} ", f" {word()}, ", f" {word()}: "))
            open_, close = r.choice((("", ""),) * 6 + (("(", ")"), ("<", ">"), ('"', '"'), ("", "%%%"), ("", "###")))
            kind = r.choice(KINDS) if i % 2 else None
            value = makers[kind]() if kind else r.choice(nothing)()
            text += open_
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value + close + r.choice(("", "", ".", ",", ";")) + f" {word()}"
        out.append((text, spans))
    return out


@lru_cache(1)
def _default() -> Crf:
    return _fitted(labelled_table())


def trained(table: list[tuple[str, list[Span]]] | None = None) -> Crf:
    """The field fitted to a table of texts and their spans; without one, to labelled_table, once in a process."""
    return _default() if table is None else _fitted(table)


def _fitted(table: list[tuple[str, list[Span]]]) -> Crf:
    k = len(LABELS)
    banned = np.array([[b[0] == "I" and a[1:] != b[1:] for b in LABELS] for a in LABELS])
    model = Crf(k, banned, np.array([x[0] == "I" for x in LABELS]))
    rows, labels = [], []
    for text, spans in table:
        for run in runs(text):
            rows.append(features(text, run))
            row = []
            for a, b in run:
                kind = next(((s, x) for s, e, x in spans if s < b and a < e), None)
                row.append(LABELS.index(f"{'B' if a <= kind[0] else 'I'}-{kind[1]}") if kind else 0)
            labels.append(row)
    packed, lengths = padded(rows)
    gold = np.zeros(packed.shape[:2], int)
    for i, row in enumerate(labels):
        gold[i, : len(row)] = row
    model.fit(packed, gold, lengths)
    return model


def valid(kind: str, text: str) -> bool:
    """Whether an added span can be of its kind."""
    digits = "".join(DIGITS.findall(text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not re.search("[A-Za-z@/%$=]", text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) >= 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4]) and "." in text
    return bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9]", text))


EDGE = " .,;:!?<>[]{}\"'*%#$&|"


def added_spans(texts: list[str], base: list[list[Span]], model: Crf) -> list[list[Span]]:
    """What the field finds beside the patterns' spans."""
    out: list[list[Span]] = [[] for _ in texts]
    todo = []
    for i, text in enumerate(texts):
        for run in runs(text):
            # a run that the patterns' spans cover has nothing to add
            if not all(any(s < b and a < e for s, e, _ in base[i]) for a, b in run):
                todo.append((len(run), i, run))
    todo.sort(key=lambda x: x[0])
    at = 0
    while at < len(todo):
        end = at + 1
        while end < len(todo) and end - at < 4096 and (end - at + 1) * todo[end][0] < 60_000:
            end += 1
        rows, lengths = padded([features(texts[i], run) for _, i, run in todo[at:end]])
        for (n, i, run), labels in zip(todo[at:end], model.viterbi(rows, lengths), strict=True):
            j = 0
            while j < n:
                name, k = LABELS[labels[j]], j + 1
                while name != "O" and k < n and LABELS[labels[k]] == "I" + name[1:]:
                    k += 1
                if name != "O":
                    a, b, text = run[j][0], run[k - 1][1], texts[i]
                    while a < b and text[a] in EDGE or a < b and text[a] == "(" and ")" not in text[a:b]:
                        a += 1
                    while a < b and text[b - 1] in EDGE or a < b and text[b - 1] == ")" and "(" not in text[a:b]:
                        b -= 1
                    if valid(name[2:], text[a:b]) and not any(s < b and a < e for s, e, _ in base[i]):
                        out[i].append((a, b, name[2:]))
                j = k
        at = end
    return out


def all_spans(texts: list[str], model: Crf) -> tuple[list[list[Span]], list[list[Span]]]:
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, model)
    return base, [sorted(b + m, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for b, m in zip(base, more, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _pieces(b: pa.RecordBatch, column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    step = max(1, int(b.num_rows * size / max(1, b.nbytes)))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts are of the patterns' spans."""
    model = trained(table)
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, 1):
                texts = [t or "" for t in b.column(1).to_pylist()]
                base, every = all_spans(texts, model)
                counts = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
                rest = [digest, pa.array([joined(x) for x in every], pa.string()), pa.array([len(y) - len(x) for x, y in zip(base, every, strict=True)], pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, *rest], names)

    schema = f"`{id_col}` long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), schema)


def redacted(docs: DataFrame, text_col: str = "text", table: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets, and n_chars, where there is one, set anew."""
    model, schema = trained(table), docs.schema
    names = schema.fieldNames()
    at = names.index(text_col)

    def replaced(text: str | None, found: list[Span]) -> str | None:
        if not found:
            return text
        out, end = [], 0
        for a, b, kind in found:
            if b > end:
                out += [text[end : max(a, end)], f"<{kind.upper()}>"] if a >= end else []
                end = b
        return "".join(out) + text[end:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, at):
                texts = b.column(at).to_pylist()
                new = [replaced(t, s) for t, s in zip(texts, all_spans([t or "" for t in texts], model)[1], strict=True)]
                columns = list(b.columns)
                columns[at] = pa.array(new, pa.string())
                if "n_chars" in names:
                    i = names.index("n_chars")
                    columns[i] = pa.array([old if s is t else len(s) for s, t, old in zip(new, texts, b.column(i).to_pylist(), strict=True)], columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(tidy(run), schema)
