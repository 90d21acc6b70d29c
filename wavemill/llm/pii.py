"""Personal data: fixed patterns, and further spans that weakly supervised labelers and a trained classifier agree on."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import common

#: The kinds, in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns of the base spans. An e-mail's local part is found backwards from its at sign, which gives the same
#: spans as the whole pattern from left to right in linear time; the look-behind does the same for addresses.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Looser forms, which only count where the classifier accepts them: an e-mail with its at sign spelt out, an address
#: with its dots spelt out, in brackets or among blanks, a card number with other separators, and a national phone number
#: of three groups.
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63})+")
_LOOSE_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[\[(](?:\.|dot)[\])] ?| \.|\. |\.)[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9./_])[0-9]{4}(?:[._/\u00a0\u2013][0-9]{2,6}){2,4}(?![0-9]|[./_][0-9])")

#: Gazetteers: top-level domains, country calling codes, issuer prefixes of cards.
_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app ai co uk de fr es it nl be ch at pt pl se no dk fi ie us ca mx br ar au nz jp cn kr in ru eu example test".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
_ISSUERS = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27")

#: Words in the CONTEXT characters before a span that speak for each kind.
_CONTEXT = {
    "email": re.compile(r"mail|contact|write to|reach|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|adresse", re.I),
    "card": re.compile(r"card|visa|credit|payment|tarjeta|karte|carte", re.I),
    "phone": re.compile(r"phone|\btel\b|\btel\.|call|fax|mobile|cell|tele|telef", re.I),
}
_OTHERWISE = re.compile(r"order|invoice|serial|\bref\b|\bpart\b|isbn|version", re.I)
CONTEXT = 32

#: A loose candidate becomes a span at this probability.
ACCEPT = 0.5


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' spans, sorted; offsets count code points and ends are exclusive."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = m.group().split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _loose(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    if "at]" in text or "at)" in text:
        out += [(m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 3, m.end()) for m in _LOOSE_PHONE.finditer(text)]
        out += [(m.start(), 1, m.end()) for m in _LOOSE_IP.finditer(text) if all(int(p) <= 255 for p in re.findall("[0-9]+", m.group()))]
        out += [(m.start(), 2, m.end()) for m in _LOOSE_CARD.finditer(text) if 12 <= sum(c in "0123456789" for c in m.group()) <= 19]
    out.sort()
    kept, k = [], 0
    for a, kind, b in out:  # both lists go by start: those that overlap a base span are its own matter
        while k < len(base) and base[k][2] <= a:
            k += 1
        if not any(s < b and a < e for s, _, e in base[k : k + 8]):
            kept.append((a, kind, b))
    return kept


def _votes(text: str, start: int, kind: int, end: int, strict: bool) -> int:
    """The labelers' votes as one number: a digit to base 3 each (0 against, 1 abstains, 2 for)."""
    span = text[start:end]
    pattern = 2 if strict else 1
    if kind == 0:
        listed = 2 if re.split(r"[.\])\s]", span)[-1].lower() in _DOMAINS else 0
    elif kind == 1:
        listed = 1 if span.startswith(("0.", "255.")) else 2
    else:
        digits = "".join(c for c in span if c in "0123456789")
        if kind == 2:
            listed = 2 if digits.startswith(_ISSUERS) and _luhn(digits) else 0
        elif strict:
            listed = 2 if digits.startswith(_CALLING) else 0
        else:
            listed = 0 if digits[0] in "01" else 1  # no area code starts so
    near = max(0, start - CONTEXT), start
    context = 2 if _CONTEXT[KINDS[kind]].search(text, *near) else 0 if _OTHERWISE.search(text, *near) else 1
    return pattern + 3 * listed + 9 * context


#: Buckets of the word before a span, and the parts of a code: kind, votes, shape, word.
BUCKETS = 32
_PARTS = (4, 27, 16, BUCKETS)

_WORD = re.compile(r"([^\W\d_]+)[\W_]*$")


def _shape(text: str, start: int, end: int) -> int:
    """What stands on either side, and the length's class; below 16."""
    before = start == 0 or text[start - 1].isspace()
    after = end == len(text) or text[end].isspace() or text[end] in ".,;:!?)"
    return before + 2 * after + 4 * min(3, (end - start) // 8)


def _word(text: str, start: int) -> int:
    """The bucket of the last word within CONTEXT characters before a span; 0 without one."""
    found = _WORD.search(text[max(0, start - CONTEXT) : start])
    return 1 + zlib.crc32(found[1].lower().encode()) % (BUCKETS - 1) if found else 0


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind, end, base, code): code holds kind, votes, shape and the word before."""
    base = base_spans(text)
    out = [(a, k, b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in _loose(text, base)]
    return sorted((a, k, b, strict, ((k * 27 + _votes(text, a, k, b, strict)) * 16 + _shape(text, a, b)) * BUCKETS + _word(text, a)) for a, k, b, strict in out)


@dataclass(frozen=True)
class Model:
    """reliabilities: kind -> labeler -> share of right votes; accepted: codes that the classifier takes for real."""

    reliabilities: dict[str, list[float]]
    weights: np.ndarray
    accepted: frozenset[int]


def _features(codes: np.ndarray) -> np.ndarray:
    """The features of each code: its kind, and by kind each labeler's vote, what stands before and after, the length's
    class, and the word before."""
    kind, votes, shape, word = np.unravel_index(codes, _PARTS)
    sizes = [1, 3, 3, 3, 2, 2, 4, BUCKETS]
    values = [np.zeros_like(kind), votes % 3, votes // 3 % 3, votes // 9, shape % 2, shape // 2 % 2, shape // 4, word]
    starts = np.cumsum([0, *sizes])
    return np.stack([kind * starts[-1] + a + v for a, v in zip(starts, values, strict=False)], axis=1)


N_FEATURES = 4 * (1 + 3 * 3 + 2 + 2 + 4 + BUCKETS)


def posteriors(counts: dict[int, int], rounds: int = 50) -> tuple[np.ndarray, dict[str, list[float]]]:
    """Chances that candidates of each code (sorted) are real, and each labeler's reliability, by expectation-maximisation.

    Each kind has its own prior and, for each labeler, its own chances of a vote given that the span is real or not;
    labelers start out as mostly right.
    """
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    kind, votes, _, _ = np.unravel_index(codes, _PARTS)
    post = np.zeros(len(codes))
    reliabilities = {}
    for k in range(4):
        mine = kind == k
        prior = 0.5
        chance = np.array([[[0.1, 0.2, 0.7], [0.6, 0.3, 0.1]], [[0.1, 0.3, 0.6], [0.5, 0.4, 0.1]], [[0.05, 0.55, 0.4], [0.15, 0.8, 0.05]]])  # labeler, real or not, vote
        at = [votes[mine] // 3**j % 3 for j in range(3)]
        for _ in range(rounds if mine.any() else 0):
            real, not_real = np.full(mine.sum(), prior), np.full(mine.sum(), 1 - prior)
            for j in range(3):
                real, not_real = real * chance[j, 0, at[j]], not_real * chance[j, 1, at[j]]
            p = real / (real + not_real)
            w = n[mine]
            prior = float(((p * w).sum() + 1) / (w.sum() + 2))
            for j in range(3):
                for v in range(3):
                    chance[j, 0, v] = ((p * w)[at[j] == v].sum() + chance[j, 0, v] * 2) / ((p * w).sum() + 2)
                    chance[j, 1, v] = (((1 - p) * w)[at[j] == v].sum() + chance[j, 1, v] * 2) / (((1 - p) * w).sum() + 2)
            post[mine] = p
        reliabilities[KINDS[k]] = [float(prior * chance[j, 0, 2] + (1 - prior) * chance[j, 1, 0]) for j in range(3)]
    return post, reliabilities


def fit(counts: dict[int, int]) -> Model:
    """posteriors(), then a logistic classifier trained on them, which alone decides.

    There are at most 4 * 27 * 16 * BUCKETS codes, so counts of the whole corpus are all that training needs.
    """
    post, reliabilities = posteriors(counts)
    codes = np.array(sorted(counts), np.int64)
    weights = np.zeros(N_FEATURES)
    if not len(codes):
        return Model(reliabilities, weights, frozenset())
    x = _features(codes)
    share = np.log1p([counts[c] for c in codes.tolist()])  # frequent codes shall not drown the rest
    share /= share.sum()
    for _ in range(500):
        p = 1 / (1 + np.exp(-weights[x].sum(axis=1)))
        weights += 4.0 * (np.bincount(x.ravel(), np.repeat(share * (post - p), x.shape[1]), N_FEATURES) - 0.0005 * weights)
    p = 1 / (1 + np.exp(-weights[x].sum(axis=1)))
    return Model(reliabilities, weights, frozenset(codes[p >= ACCEPT].tolist()))


_FOUND = {
    "doc_id": pa.int64(), "n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base_sha256": pa.string(),
    "found": pa.list_(pa.struct([("span", pa.string()), ("base", pa.bool_()), ("code", pa.int32())])),
}
_FOUND_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<span: string, base: boolean, code: int>>"


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in _FOUND]
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        spans = candidates(text or "")
        named = [(f"{KINDS[k]}:{a}:{b}", strict, code) for a, k, b, strict, code in spans]
        kinds = [k for _, k, _, strict, _ in spans if strict]
        base = ",".join(s for s, strict, _ in named if strict)
        for column, value in zip(columns, (doc_id, *(kinds.count(k) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), [{"span": s, "base": b, "code": c} for s, b, c in named]), strict=True):
            column.append(value)
    return common.record(_FOUND, *columns)


def scan(docs: DataFrame) -> DataFrame:
    """Candidates of docs(doc_id, text), base spans and loose ones: one row per row, however its text is."""
    rows = common.only(docs, doc_id="long", text="string")
    return common.over_texts(rows, _scan, _FOUND_SCHEMA)


def train(found: DataFrame) -> Model:
    """A model from all candidates of a scan(): only the counts of their codes come to the driver."""
    codes = found.select(F.explode("found").alias("c")).groupBy("c.code").count()
    return fit({r["code"]: r["count"] for r in codes.collect()})


def find(docs: DataFrame) -> DataFrame:
    """Personal data in docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans; spans lists them and those that the model adds, by start and kind.
    Null and empty texts have none (the digest of an empty string). Repeated rows are a row each; an empty table gives
    an empty result. Spans of different kinds may overlap; added ones overlap no base span.
    """
    found = common.keep(scan(docs), "candidates")
    accepted = train(found).accepted
    out = {k: v for k, v in _FOUND.items() if k != "found"} | {"spans": pa.string()}

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [",".join(c["span"] for c in row or [] if c["base"] or c["code"] in accepted) for row in batch.column("found").to_pylist()]
        return common.record(out, *(batch.column(c) for c in out if c != "spans"), spans)

    return common.over_texts(found, keep, _FOUND_SCHEMA.replace("found array<struct<span: string, base: boolean, code: int>>", "spans string"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by its kind in angle brackets; other columns and rows as they were.

    Overlapping spans become one, of the kind that starts first. Null texts stay null. Texts are read twice, once for the
    counts that training needs: that takes less than writing them down together with their candidates.
    """
    accepted = train(common.keep(scan(docs), "candidates")).accepted
    names = docs.columns
    docs = common.guarded(docs, "text")
    place = docs.columns.index("text")

    def clean(text: str) -> str:
        spans = [(a, k, b) for a, k, b, strict, code in candidates(text) if strict or code in accepted]
        if not spans:
            return text
        parts, end, at = [], 0, 0
        for a, k, b in spans:
            if a >= end or not parts:
                parts += [text[at:a], f"<{KINDS[k].upper()}>"]
            end = max(end, b)
            at = end
        return "".join([*parts, text[at:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else clean(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array(texts, batch.schema.field(place).type) if n == place else batch.column(n) for n in range(len(names))]
        return pa.record_batch(columns, schema=batch.schema)

    return common.over_texts(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)).toDF(*names)
