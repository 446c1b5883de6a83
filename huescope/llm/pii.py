"""Personal data: fixed patterns, then boosted trees over candidate spans.

The base finds e-mail addresses, IPv4 addresses, payment cards and phone
numbers by fixed rules, in linear time.  High-recall generators then propose
further, possibly overlapping spans: numbers without a leading plus, parts of
digit runs that the base gave up as a whole, written out "at" and "dot", other
separators.  Boosted trees judge each proposal by its format and its context.

What the base misses carries no label, so the trees never learn from it.
They learn from base spans rewritten in the forms that the base cannot read
(positive) against the same forms with a check broken, number formats that
are no personal data, and proposals in the text that fail their kind's check
(negative).  A threshold calibrated on held-back examples selects the spans
to add; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import BoostedTrees
from .common import bounded_batches, hash_share, sample_rows, strings

KINDS = ("email", "ip", "card", "phone")
#: The base patterns' parts.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.+[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PART = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append(("email", start, free))
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[Span]:
    out = []
    for run in _DOTTED.finditer(text):
        parts, k = list(_PART.finditer(text, *run.span())), 0
        while k + 4 <= len(parts):
            four = parts[k : k + 4]
            broken = next((j for j in (2, 1, 0) if four[j + 1].start() - four[j].end() != 1), None)
            if broken is not None:
                k += broken + 1
                continue
            if all(len(p := x.group().lstrip("0")) < 4 and int(p or 0) <= 255 for x in four):
                out.append(("ip", four[0].start(), four[3].end()))
            k += 4
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind and start."""
    out = _emails(text)
    if "." in text:
        out += _ips(text)
    for found in _CARD.finditer(text):
        a, b = found.span()
        if b - a >= 13:
            digits = found.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", a, b))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, found.group())) <= 15:
                out.append(("phone", *found.span()))
    return out


#: Generators of the proposals, by the kind that they propose.
_PROPOSE = (
    ("card", re.compile(r"(?<![0-9A-Za-z.+])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.])(?:\+|00|\()?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?: ?[.,:] ?|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9A-Za-z])")),
)
_SPELT = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,63}){1,4}")
_RUN = re.compile(r"\+?[0-9](?:[ ().-]{0,2}[0-9])+")
_HINTS = re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|mail|contact|card|visa|iban|account|ip|host|server)\b")
_MARKS = ("@", "(at)", "[at]", "{at}", " at ")


def _groups(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Where the digit groups of a run lie."""
    return [m.span() for m in _PART.finditer(text, a, b)]


def _parts(text: str) -> list[Span]:
    """Cards and phones inside digit runs that are too long for either, as
    happens where two numbers stand side by side: some neighbouring groups of
    at least three digits, or a plus with its first groups.  A run of n
    groups gives at most some 7 n proposals."""
    out = []
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a < 14:
            continue
        groups = _groups(text, a, b)
        if len(groups) < 2:
            continue
        for i in range(len(groups)):
            digits = 0
            for j in range(i, len(groups)):
                size = groups[j][1] - groups[j][0]
                digits += size
                if size < 3 or digits > 19:
                    break
                if digits >= 13 and (i, j) != (0, len(groups) - 1):
                    out.append(("card", groups[i][0], groups[j][1]))
        if text[a] == "+":
            digits = 0
            for j in range(len(groups) - 1):
                digits += groups[j][1] - groups[j][0]
                if digits > 15:
                    break
                if digits >= 9:
                    out.append(("phone", a, groups[j][1]))
    return out


def proposals(text: str) -> list[Span]:
    """Candidate spans of all generators; they may overlap.

    Linear in the text but for a bounded number of proposals a digit group.
    """
    out = []
    if any(map(text.__contains__, _MARKS)):
        out += [("email", *m.span()) for m in _SPELT.finditer(text)]
    if _PART.search(text):
        for kind, pattern in _PROPOSE:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
        out += _parts(text)
    return list(dict.fromkeys(out))


def valid(kind: str, body: str) -> bool:
    """Whether the written form can be what its kind says."""
    groups = _PART.findall(body)
    digits = "".join(groups)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "ip":
        return len(groups) == 4 and all(int(x) <= 255 for x in groups)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    low = body.lower()
    return "@" in low or any(a in low for a in ("(at)", "[at]", "{at}")) or " at " in low and " dot " in low


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of one proposal."""
    kind, a, b = span
    body, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 24]
    low, words = body.lower(), _PART.findall(body)
    groups = list(map(len, words)) or [0]
    digits = "".join(words)
    return [
        float(KINDS.index(kind)), b - a, len(digits), len(groups), groups[0], groups[-1], max(groups), min(groups), body.count(" "), body.count("-"), body.count("."), body.count("/") + body.count("_"), float("(" in body and "at" not in low and "dot" not in low),
        len(set(digits)) / (len(digits) or 1), float(body[:1] == "+"), float(digits[:2] == "00"), sum(map(str.isalpha, body)) / (b - a), float("@" in body), float(" at " in low), float(any(x in low for x in ("(at)", "[at]", "{at}"))), float("dot" in low), float(". " in body),
        float(kind == "card" and _luhn(digits)), float(kind == "ip" and len(words) == 4 and max(len(w) for w in words) < 4 and max(map(int, words)) <= 255), float(len(set(re.sub(r"[0-9A-Za-z]+", "", body))) > 1), float(body.count(",") + body.count(":")),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(bool(_HINTS.search(before))),
    ]


class _Taken:
    """Intervals that do not overlap, asked and extended in log time."""

    def __init__(self, spans: list[Span] = ()):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        """Does an interval overlap [a, b)?"""
        return bisect_right(self.ends, a) < bisect_left(self.starts, b)

    def add(self, a: int, b: int) -> None:
        insort(self.starts, a)
        insort(self.ends, b)


#: Rewritten forms of a span, by kind; ``w`` are its digit groups or its local part and labels.
_FORMS = {
    "email": (lambda w: f"{w[0]} (at) {' (dot) '.join(w[1:])}", lambda w: f"{w[0]}[at]{'[dot]'.join(w[1:])}", lambda w: f"{w[0]} at {' dot '.join(w[1:])}", lambda w: f"{w[0]} @ {'.'.join(w[1:])}", lambda w: f"{w[0]}(at){'.'.join(w[1:])}", lambda w: f"{w[0]}{{at}}{'{dot}'.join(w[1:])}"),
    "ip": (lambda w: "[.]".join(w), lambda w: "(.)".join(w), lambda w: " . ".join(w)),
    "card": (".".join, "/".join, "_".join, "  ".join, lambda w: f"{' '.join(w)} 48213377", lambda w: f"7302 {''.join(w)}", lambda w: f"{''.join(w)} 9182736455463728"),
    "phone": (" ".join, "-".join, ".".join, "/".join, lambda w: f"00{' '.join(w)}", lambda w: f"({w[0]}) {' '.join(w[1:])}", lambda w: f"tel {''.join(w)}", lambda w: f"+{' '.join(w)} 7302918273645546"),
}
#: Number formats and phrases that are no personal data, to stand in a span's place.
_OTHER = ("2021-03-14", "14.03.2021 08:15:30", "3.14159265358979", "1,234,567.89", "473696257", "9780306406157300", "10:30:45:200", "1.2.3.400", "300.1.2.3", "pages 1180 1193 2204", "1990 1995 2000 2005", "12 of 144 at 7. Those", "look at this. There", "at noon dot and", "20240131235959", "0,1,2,3", "555 1234", "8 9 10 11 12 13 14 15 16")


def _words_of(kind: str, body: str) -> list[list[str]]:
    """Ways to cut a span into local part and labels, or into digit groups."""
    if kind == "email":
        local, _, domain = body.rpartition("@")
        labels = domain.split(".")
        bare = re.sub(r"[^A-Za-z]+", "", local) or local
        return [[local, *labels], [bare, *(re.sub(r"[0-9]+", "", x) or x for x in labels)], [bare, *labels[-2:]]]
    groups = _PART.findall(body)
    if kind == "ip":
        return [groups]
    digits = "".join(groups)
    cut = lambda *sizes: [digits[a:b] for a, b in zip((0, *np.cumsum(sizes)), (*np.cumsum(sizes), len(digits))) if digits[a:b]]
    if kind == "card":
        return [groups if len(groups) > 1 else cut(4, 4, 4), cut(4, 4, 4), cut(4, 6)]
    return [groups, cut(3, 3), cut(2, 2), cut(2, 3, 3), cut(4, 3), groups[1:] if len(groups) > 3 and sum(map(len, groups[1:])) >= 9 else groups]


def _broken(kind: str, words: list[str]) -> list[str]:
    """The same words with the kind's check failing."""
    if kind == "card":
        last = words[-1]
        return [*words[:-1], last[:-1] + str((int(last[-1]) + 1 + len(last) % 8) % 10)]
    if kind == "ip":
        return [str(256 + int(words[0][:3]) % 700), *words[1:]]
    if kind == "phone":
        return ["".join(words)]  # a bare number that nothing announces
    return [words[0], "the"]


def examples(text: str, most: int = 6) -> list[tuple[list[float], int]]:
    """Labelled proposals made from one text: features, and 1 if the proposal
    is personal data.  At most ``most`` base spans a kind are rewritten and as
    many plain proposals used, chosen by a hash of the text."""
    out, base = [], base_spans(text)
    seed = zlib.crc32(text.encode())
    taken = _Taken(base)

    def judged(kind: str, a: int, b: int, body: str, label: int) -> None:
        """What the generators make of the text with ``body`` in [a, b)."""
        left, right = text[max(0, a - 40) : a], text[b : b + 40]
        mine = f"{left}{body}{right}"
        inner = _Taken([(kind, len(left), len(left) + len(body))])
        known = _Taken(base_spans(mine)) if label else None
        for s in proposals(mine):
            if not inner.meets(s[1], s[2]) or known is not None and known.meets(s[1], s[2]):
                continue
            good = label and s[0] == kind and valid(kind, mine[s[1] : s[2]]) and _core(mine[s[1] : s[2]], kind) == want
            if good or not label or s[0] != kind or not valid(kind, mine[s[1] : s[2]]):
                out.append((describe(mine, s), int(bool(good))))

    for kind in KINDS:
        of_kind = [s for s in base if s[0] == kind]
        for n in range(min(most, len(of_kind))):
            _, a, b = of_kind[(seed + n * 7919) % len(of_kind)]
            ways = _words_of(kind, text[a:b])
            for k, form in enumerate(_FORMS[kind]):
                words = ways[(seed + n + k) % len(ways)]
                want = _core("@".join((words[0], ".".join(words[1:]))) if kind == "email" else "".join(words), kind)
                judged(kind, a, b, form(words), 1)
            want = None
            for k in (0, 1):
                words = ways[(seed + n + k) % len(ways)]
                judged(kind, a, b, _FORMS[kind][(seed + n + k) % len(_FORMS[kind])](_broken(kind, words)) if kind != "phone" else _broken(kind, words)[0], 0)
                if kind == "ip":
                    judged(kind, a, b, ".".join(_broken(kind, words)), 0)
                    judged(kind, a, b, ".".join(str(256 + (37 * k + int(x[:3])) % 744) for x in words), 0)
                judged(kind, a, b, _OTHER[(seed // 7 + 2 * n + k) % len(_OTHER)], 0)
    plain = [s for s in proposals(text) if not taken.meets(s[1], s[2])]
    for n in range(min(4 * most, len(plain))):
        s = plain[(seed + n * 7919) % len(plain)] if len(plain) > 4 * most else plain[n]
        if not valid(s[0], text[s[1] : s[2]]) or s[0] == "phone" and len(_groups(text, s[1], s[2])) == 1 and not _HINTS.search(text[max(0, s[1] - 24) : s[1]]):
            out.append((describe(text, s), 0))
    return out


def _core(body: str, kind: str) -> str:
    """What stays of a span whatever way it is written."""
    if kind != "email":
        return "".join(_PART.findall(body)).lstrip("0")
    return re.sub(r"[^a-z0-9]+", "", re.sub(r"[(\[{ ](?:at|dot)[)\]} ]", "", body.lower()))


class PiiModel:
    """Boosted trees and, for each kind, the threshold that reaches the
    wanted precision on every third example, which the trees did not see.
    A kind without such a threshold adds nothing."""

    def __init__(self, x: np.ndarray, y: np.ndarray, precision: float):
        third = np.arange(len(y)) % 3 == 0
        self.trees, self.thresholds = BoostedTrees(trees=60, depth=4), dict.fromkeys(KINDS, 2.0)
        if not len(y) or y.min() == y.max():
            return
        self.trees.fit(x[~third], y[~third])
        p = self.trees.probability(x[third])
        for n, kind in enumerate(KINDS):
            mine = x[third][:, 0] == n
            q, label = p[mine], y[third][mine]
            order = np.argsort(-q, kind="stable")
            # the lowest score above which the share of true examples, smoothed, suffices
            share = (np.cumsum(label[order]) + 1) / (np.arange(len(order)) + 1.0 + 1.0)
            good = np.flatnonzero((share >= precision) & (label[order] == 1))
            if len(good):
                # halfway to the next example below, which would break the precision or does not exist
                below = q[order[good[-1] + 1 :]]
                self.thresholds[kind] = max(float(q[order[good[-1]]] + (below[0] if len(below) else 0.0)) / 2, 0.5)


def find(text: str, model: PiiModel | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a whole text, by kind and start.

    Proposals that meet a base span go; of the rest the likeliest is taken
    first, and what it overlaps goes.  n log n in the proposals.
    """
    base = base_spans(text)
    if model is None or min(model.thresholds.values()) > 1:
        return base, []
    known = _Taken(base)
    more = [s for s in proposals(text) if not known.meets(s[1], s[2]) and valid(s[0], text[s[1] : s[2]])]
    if not more:
        return base, []
    p = np.concatenate([model.trees.probability(np.array([describe(text, s) for s in more[k : k + 20_000]])) for k in range(0, len(more), 20_000)])
    taken, chosen = _Taken(), []
    for k in np.lexsort((np.arange(len(p)), -p)):
        kind, a, b = more[k]
        if p[k] >= model.thresholds[kind] and not taken.meets(a, b):
            taken.add(a, b)
            chosen.append(more[k])
    return base, sorted(chosen, key=lambda s: (KINDS.index(s[0]), s[1]))


def learn(docs: DataFrame, *, sample: int = 4_000, most_examples: int = 20_000, precision: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> PiiModel:
    """Learn from examples made of about ``sample`` documents that hold a
    digit or an at sign, chosen by a hash of id and text (null ids take no
    part, repeated rows count once); at most ``most_examples`` of them, those
    of the smallest hash."""
    bounded_batches(docs.sparkSession)
    some = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("i").isNotNull() & F.col("t").rlike("[0-9@]"))
    n = some.count()

    def run(batches):
        for b in batches:
            found = [e for t in strings(b.column("t")) for e in examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([y for _, y in found], pa.int32()), pa.array([x for x, _ in found], pa.list_(pa.float64()))], names=["y", "x"])

    chosen = some.where(hash_share(F.xxhash64("i", "t"), sample / max(n, 1))).dropDuplicates(["i", "t"])
    got = sample_rows(chosen.mapInArrow(run, "y int, x array<double>"), ["x", "y"], most_examples)  # in order of their hash
    return PiiModel(np.array([r.x for r in got]).reshape(len(got), len(got[0].x) if got else 0), np.array([r.y for r in got], float), precision)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: PiiModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for
    every row; counts and hash are of the base, ``spans`` holds all.

    Positions are code points, ends exclusive.  A null text counts as empty.
    Each row is judged alone.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        m = shared.value
        for b in batches:
            counts, hashes, spans, added = [[] for _ in KINDS], [], [], []
            for t in strings(b.column("t")):
                base, more = find(t, m)
                for c, k in zip(counts, KINDS):
                    c.append(sum(s[0] == k for s in base))
                hashes.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([b.column("i"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, model: PiiModel | None) -> str:
    """The text with each span replaced by its kind in angle brackets;
    overlapping spans become one, named after the first."""
    base, more = find(text, model)
    out, end = [], 0
    for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, model: PiiModel | None, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all its columns and rows, its texts redacted and, where
    there is one, the character count brought up to date; nulls stay null."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = [None if t is None else redacted(t, m) for t in b.column(text_col).to_pylist()]
            yield b.set_column(b.schema.get_field_index(text_col), b.schema.field(text_col), pa.array(texts, b.schema.field(text_col).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
