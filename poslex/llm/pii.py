"""Personal data by weak supervision.

Candidate spans are cut by broad patterns out of the surroundings of words that hold a digit, '@' or '='. Labelers
vote on each candidate for (1), against (2) or not at all (0): a strict pattern, a check sum or range, gazetteers
(top-level domains, card issuers, calling codes, reserved addresses, key prefixes), the context words around it, its variety of characters, and
its borders. Expectation-maximisation over all candidates estimates how reliable each labeler is and how likely each
candidate is personal data; these likelihoods are the soft labels on which the span classifier, a logistic regression
over votes, kind and length, is fitted. Spans of at least ``least`` probability are returned.

Both models see nothing but the count of each combination of kind, length class and votes, whose number doesn't grow
with the corpus; the counts are over all candidates of all documents.

Edge cases: null, empty and plain texts have no spans. Places are in code points of the text, end exclusive; they
don't overlap within a document. Long texts are scanned whole, unbroken ones too, in time in proportion to their length. Rows are independent: repeated rows give their spans each, with
whatever doc_id they have. Without any candidate the result is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _run, _vec

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
LABELERS = ("strict", "checked", "gazetteer", "context", "variety", "borders")
LEAST = 0.5
#: Words on either side that make up a candidate's surroundings.
AROUND = 4
_LENGTHS = 4

#: Parts of an address are as long as standards allow, so that the search takes time in proportion to the text, whatever it holds.
_EMAIL = r"(?P<email>[^\W_][\w.+%-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+)|"
_OTHERS = (
    r"(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))"
    r"|(?P<secret>(?<![\w/+-])(?=[A-Za-z_+/-]*\d)(?:sk-|gh[pousr]_|AKIA|xox[baprs]-|eyJ)?[A-Za-z0-9_+/-]{16,}={0,2}(?![\w/+-]))"
    r"|(?P<phone>(?<![\w.,:/+-])\(?(?:\+|00)?\d{1,3}(?:[ ./-]?\(\d{1,4}\)|[ ./-]?\d{1,4})(?:[ ./-]?\d{2,5}){1,4}(?![\w-]|[.,:/]\d))"
)
_CANDIDATE, _WITHOUT_AT = re.compile(_EMAIL + _OTHERS), re.compile(_OTHERS)
_STRICT = {
    "email": re.compile(r"[\w][\w.+%-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "card": re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ -])\d{6}\2\d{5}"),
    "phone": re.compile(r"(?:\+|00)\d{1,3}[ ./-]?\(?\d{1,4}\)?(?:[ ./-]?\d{2,5}){1,4}|\(\d{2,4}\)[ -]?\d{3,4}[ -]?\d{3,5}|\d{3}[-. ]\d{3}[-. ]\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "ssn": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "secret": re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk-|gh[pousr]_|AKIA|xox[baprs]-|eyJ)[A-Za-z0-9_+/-]{12,}={0,2}|(?=[^\d]*\d)(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9_+/-]{24,}={0,2})"),
}
_TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be at ch pl cz se no dk fi pt ru cn jp kr in br mx ar cl au nz ca us eu ie gr hu ro tr il za".split())
_CODES = tuple("+1 +7 +20 +27 +30 +31 +32 +33 +34 +36 +39 +40 +41 +43 +44 +45 +46 +47 +48 +49 +51 +52 +54 +55 +56 +57 +60 +61 +62 +63 +64 +65 +66 +81 +82 +84 +86 +90 +91 +351 +352 +353 +358 +420".split())
_FOR = {
    "email": "mail email e-mail correo courriel contact write kontakt contacto",
    "ip": "ip address host server adresse login from client dirección",
    "card": "card visa mastercard amex credit debit carte karte tarjeta pan payment kredit",
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon handy téléphone teléfono móvil appel ruf",
    "iban": "iban bank account konto compte cuenta bic",
    "ssn": "ssn social security tax",
    "secret": "token key secret password passwd pwd api apikey auth bearer credential private access =",
}
_AGAINST = frozenset("version isbn issn doi order invoice page pages fig figure table chapter section volume vol no nr total price sha256 checksum commit md5".split())
_WORD = re.compile(r"[^\W_][\w-]*|=")
_CONTEXT = {k: frozenset(v.split()) for k, v in _FOR.items()}
_HOT = np.zeros(256, np.bool_)
_HOT[list(b"0123456789@=")] = True


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """The labelers' votes on a candidate: 1 for, 2 against, 0 none."""
    digits = re.sub(r"\D", "", span)
    strict = 1 if _STRICT[kind].fullmatch(span) else 2
    checked = gazetteer = 0
    if kind == "email":
        gazetteer = 1 if span.rsplit(".", 1)[-1].lower() in _TOP_DOMAINS else 2
        checked = 2 if ".." in span or len(span) > 254 else 1
    elif kind == "ip":
        parts = [int(x) for x in span.split(".")]
        checked = 1 if max(parts) <= 255 else 2
        gazetteer = 2 if parts[0] in (0, 127) or parts[0] > 239 or parts == [255] * 4 or parts[0] < 10 and parts[1] < 10 else 1
    elif kind == "card":
        checked = 1 if _luhn(digits) else 2
        gazetteer = 1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|62|35", digits) else 2
    elif kind == "phone":
        checked = 1 if 8 <= len(digits) <= 15 else 2
        gazetteer = 1 if span.startswith(_CODES) else 0
    elif kind == "iban":
        plain = span.replace(" ", "")
        checked = 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else 2
    elif kind == "secret":
        kinds = sum(bool(re.search(p, span)) for p in (r"\d", "[a-z]", "[A-Z]"))
        checked = 1 if kinds >= 2 and len(digits) >= len(span) / 8 else 2
        gazetteer = 1 if re.match(r"sk-|gh[pousr]_|AKIA|xox|eyJ", span) else 0
    near = {w.lower() for w in _WORD.findall(before)[-AROUND:]} | {w.lower() for w in _WORD.findall(after)[:2]}
    context = 1 if near & _CONTEXT[kind] else 2 if near & _AGAINST else 0
    body = digits if kind in ("ip", "card", "phone", "ssn") else re.sub(r"\W", "", span)
    distinct = len(set(body))
    variety = 2 if distinct <= 2 else 1 if distinct >= min(6, len(body)) else 0
    left, right = before[-1:], after[:1]
    borders = 1 if (not left or left.isspace() or left in "\"'(<[:=,;") and (not right or right.isspace() or right in "\"')>],.;:!?") else 2
    return strict, checked, gazetteer, context, variety, borders


def code(kind: int, length: int, vote: tuple[int, ...]) -> int:
    out = kind * _LENGTHS + min(_LENGTHS - 1, length // 12)
    for v in vote:
        out = 3 * out + v
    return out


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, length class and votes of codes."""
    v = np.empty((len(codes), len(LABELERS)), np.int64)
    rest = codes.copy()
    for i in reversed(range(len(LABELERS))):
        rest, v[:, i] = np.divmod(rest, 3)
    return rest // _LENGTHS, rest % _LENGTHS, v


def candidates(column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """Row, first and last place in code points, and code of every candidate."""
    for at, to in _vec.chunks(column):
        raw, off = _vec.buffers(column[at:to])
        start, end, row = _vec.tokens(raw, off)
        if not len(start):
            continue
        sums = np.r_[0, np.cumsum(_HOT[raw])]
        hot = np.flatnonzero(sums[end] > sums[start])
        if not len(hot):
            continue
        # surroundings of hot words; those that touch are one window
        first = np.maximum(hot - AROUND, np.searchsorted(row, row[hot], "left"))
        last = np.minimum(hot + AROUND, np.searchsorted(row, row[hot], "right") - 1)
        new = np.r_[True, first[1:] > last[:-1]]
        a, b = first[new], np.maximum.reduceat(last, np.flatnonzero(new))
        chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        data = raw.tobytes()
        for s, e, r in zip(start[a].tolist(), end[b].tolist(), row[a].tolist(), strict=True):
            window, base = data[s:e].decode("utf-8"), int(chars[s] - chars[off[r]])
            for m in (_CANDIDATE if "@" in window else _WITHOUT_AT).finditer(window):
                kind = m.lastgroup
                vote = votes(kind, m[0], window[max(0, m.start() - 80) : m.start()], window[m.end() : m.end() + 40])
                yield at + r, base + m.start(), base + m.end(), code(KINDS.index(kind), m.end() - m.start(), vote)


def expectation_maximisation(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each combination to be personal data; and P(vote | class) of each labeler, (labelers, 2, 3)."""
    p = np.clip(0.5 + 0.15 * ((vote == 1).sum(1) - (vote == 2).sum(1)), 0.05, 0.95)
    table = np.zeros((vote.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        prior = np.array([[(weight[c][kind == k]).sum() + 1 for c in range(2)] for k in range(len(KINDS))])
        prior /= prior.sum(1, keepdims=True)
        for j in range(vote.shape[1]):
            for c in range(2):
                table[j, c] = np.bincount(vote[:, j], weights=weight[c], minlength=3) + 1
                table[j, c] /= table[j, c].sum()
        score = np.log(prior[kind])
        for j in range(vote.shape[1]):
            score = score + np.log(table[j][:, vote[:, j]]).T
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p, table


def classifier(codes: np.ndarray, n: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Probability of each code under a logistic regression fitted to the soft labels of expectation-maximisation."""
    kind, length, vote = decoded(codes)
    p, _ = expectation_maximisation(kind, vote, n.astype(np.float64))
    x = np.concatenate([np.eye(len(KINDS))[kind], np.eye(_LENGTHS)[length], *((vote[:, j : j + 1] == [1, 2]).astype(float) for j in range(len(LABELERS)))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (n * (p - q)) - ridge * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(candidates(_vec.texts(batch.column(1))))
        row, a, b, c = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(a), pa.array(b), pa.array(c)], ["doc_id", "first", "last", "code"])


def spans(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, kind, first, last, probability of every span of personal data."""
    spark = docs.sparkSession
    found = docs.select("doc_id", "text").mapInArrow(_found, f"doc_id {dict(docs.dtypes)['doc_id']}, first long, last long, code long")
    found = _run.materialise(found, "candidates")
    counts = found.groupBy("code").count().orderBy("code").toArrow()
    codes, n = counts["code"].to_numpy(), counts["count"].to_numpy()
    p = classifier(codes, n) if len(codes) else np.zeros(0)
    kinds = [KINDS[k] for k in decoded(codes)[0]]
    scored = spark.createDataFrame([(int(c), k, float(round(x, 6))) for c, k, x in zip(codes, kinds, p, strict=True) if x >= least], "code long, kind string, probability double")
    # at most 7 * 4 * 3 ** 6 rows
    return found.join(F.broadcast(scored), "code").select("doc_id", "kind", "first", "last", "probability")


def query(spark, sf_dir: str) -> DataFrame:
    """The spans of all documents."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
