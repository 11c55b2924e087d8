"""Personal data and secrets by weak supervision (operator 8).

A wide pattern proposes spans: whatever looks like an address, a run of digits, a dotted quad or a long token, right or wrong. Labelers vote on each, for or against or not at all: patterns (full syntax, check digits), gazetteers (domains, prefixes, key words) and context (words before, signs around). Expectation-maximisation over all votes (a naive Bayes mixture of two classes for each kind) estimates how reliable each labeler is and the spans' probabilities, with no hand label; on these a logistic regression over the span's own features is trained, the final classifier, which decides every span. Only counts of vote and feature patterns, whose number the labelers bound, come to the driver; they cover all documents.

Votes look at the 24 characters before a span and the 2 after it. Words of letters only are proposed as secrets after a key word or in a known form, not elsewhere.

Defined cases: a null or empty text has no span, nor has an empty table; a text of any length is read whole; a probability of exactly 0.5 counts as private; repeated rows have equal spans; spans are offsets in characters, end exclusive, and don't overlap (a proposal that another overlaps gives way to the one that starts first, then to the longer); other columns don't matter.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm import common

CHECK_DIGITS = {"card", "iban"}
KINDS = ["email", "phone", "card", "ip", "secret", "ssn", "iban"]
PROPOSE = re.compile(
    r"(?P<pem>-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\s]*[A-Za-z0-9+/=])?)"
    r"|(?P<keyed>(?i:passw(?:or)?d|passphrase|pwd|token|secret|api[_ -]?key|access[_ -]?key|auth(?:orization)?|credentials?|private[_ -]?key|bearer)(?i:[_ -]?(?:id|key|token))?[\"'`]?\s{0,3}(?::=|=>|[=:]|(?<=[Bb]earer)(?=\s))\s{0,3}(?i:(?:bearer|basic)\s+)?(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|`(?P<back>[^`\n]+)`|(?P<bare>[^\s\"'`]+)))|"
    r"(?P<email>[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)*)"
    r"|(?P<ip>(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){6,7}[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4})(?![\w:])|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]*\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<secret>(?<![\w-])(?:(?=[\w-]*\d)(?=[\w-]*[A-Za-z])[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{16,}|xox[bap]-[A-Za-z0-9-]{10,})(?![\w-])|(?<![\w+/=-])(?=[\w+/-]*[+/])(?=[\w+/-]*\d)(?=[\w+/-]*[a-z])(?=[\w+/-]*[A-Z])[A-Za-z0-9_+/-]{20,}={0,2}(?![\w+/=-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.])(?!00(?:[ -]?\d){11,13}(?![ -]?\d|\w))\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<phone>(?<![\w.])(?:(?=[+(]{0,2}(?:%s{0,3}\d){7})(?:\+ ?)?(?:\(\+?\d{1,5}\)|\d)(?:%s{0,2}(?:\(\d{1,5}\)|\d)){2,14}(?!\w|\.\d)" % (r"[ ./()+\u00a0\u202f\u2011\u2013-]", r"[ ./\u00a0\u202f\u2011\u2013-]") +
    r"|(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,5}){1,4}(?![\w.]*\d)))"
)
#: Gazetteers.
_COUNTRIES = "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
_TLD = set(_COUNTRIES.split()) | set("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev page cloud online site shop store tech blog xyz club live news email work world today agency company group digital media network systems solutions services support software design studio team wiki zone email global academy art bank bio care city community consulting events finance fund health house law life ltd market money one photo social space video web website win".split())
#: Length of an IBAN by country.
_IBAN = {k[:2]: int(k[2:]) for k in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}
_KEYWORD = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_ -]?key|access[_ -]?key|auth(?:orization)?|credentials?|private[_ -]?key|bearer)\W{0,6}$")
_ASSIGN = re.compile(r"(?i)(?:[=:]>?\s*(?:(?:bearer|basic)\s+)?|bearer\s+)[\"'`]?$")
#: Too short for the entropy to tell, but of letters and of other signs.
_MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[^A-Za-z\s'.,-]).{6,19}")
_CALL = re.compile(r"(?i)(?:tel|phone|call|mobile|cell|fax|contact|dial|whats ?app)\W{0,4}(?:\w+\W+)?$")
_PAY = re.compile(r"(?i)(?:card|visa|master|amex|credit|debit|payment|iban|account|konto|cuenta|compte)\W{0,4}(?:\w+\W+)?$")
_MAIL = re.compile(r"(?i)(?:mail|contact|write|from|to|cc)\W{0,4}$")
_HOST = re.compile(r"(?i)(?:ip|host|server|address|addr|from|login|client)\W{0,4}$")
_NUMBERING = re.compile(r"(?i)(?:version|ver|v|section|chapter|release|page|fig|figure|isbn|id|no|nr|hash|checksum|sha\d*|md5|commit|uuid)\W{0,3}$")
#: Phone numbers as written in America, and in pairs; any with the country's code.
_GROUPS = re.compile(r"(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}|(?:(?:\+|00)\d{2}(?: ?\(0\))?[ .-]?\d|0\d)(?:[ .-]\d\d){4}")
_ABROAD = re.compile(r"\(?(?:\+|00) ?[1-9]\d{0,2}\)?(?:\W{0,2}\d){6,14}|\(?(?:\+|00) ?[1-9]\d{0,2}\)?(?:[^\w(]{0,2}\(\d{1,5}\))(?:\W{0,2}\d){5,13}")
LABELERS = ["syntax", "check", "gazetteer", "context", "against"]
FEATURES = 9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def entropy(s: str) -> float:
    n = np.bincount(np.frombuffer(s.encode("utf-8", "ignore"), np.uint8))
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def votes(kind: str, span: str, before: str, after: str) -> list[int]:
    """1 for, -1 against, 0 no vote, of each labeler."""
    digits = re.sub(r"\D", "", span)
    against = -1 if _NUMBERING.search(before) else 0
    if kind == "email":
        user, _, host = span.rpartition("@")
        syntax = 1 if re.fullmatch(r"[A-Za-z0-9][\w.+-]*", user) and re.fullmatch(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", host) else -1
        return [syntax, 1 if "." in host and ".." not in span else -1, 1 if host.rpartition(".")[2].lower() in _TLD else 0, 1 if _MAIL.search(before) else 0, against]
    if kind == "phone":
        abroad = span[0] == "+" or span[:2] in ("00", "(+")
        syntax = -1 if not 7 <= len(digits) <= 15 else 1 if len(digits) >= 9 and (abroad or span[0] == "(" or (span[0] == "0" and len(digits) <= 12)) else 0
        if _GROUPS.fullmatch(span) or (abroad and _ABROAD.fullmatch(span)):
            grouped = 1
        else:
            grouped = 0 if span.isdigit() and syntax >= 0 else -1
        return [syntax, grouped, 1 if re.match(r"\(?(?:\+|00) ?(?:1|7|[2-689]\d)", span) else 0, 1 if _CALL.search(before) else 0, against or (-1 if re.match(r"(?:19|20)\d\d\b", span) else 0)]
    if kind == "card":
        return [1 if 13 <= len(digits) <= 19 else -1, 1 if luhn(digits) else -1, 1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)", digits) else -1, 1 if _PAY.search(before) else 0, against]
    if kind == "ip" and ":" in span:
        try:
            ip = ipaddress.IPv6Address(span)
        except ValueError:
            return [-1, -1, -1, 1 if _HOST.search(before) else 0, against]
        return [1, 1, 1 if ip.is_global else -1, 1 if _HOST.search(before) else 0, against]
    if kind == "ip":
        parts = [int(x) for x in span.split(".")]
        return [1 if max(parts) < 256 else -1, -1 if any(len(x) > 1 and x[0] == "0" for x in span.split(".")) else 1, -1 if parts[0] in (0, 127, 255) or parts[:2] == [192, 168] or parts[0] == 10 else 1 if parts[0] < 224 else -1, 1 if _HOST.search(before) else 0, against]
    if kind == "secret":
        if span.startswith("-----BEGIN "):
            return [1, 1, 1, 1, 0]
        if re.fullmatch(r"[^\W\d_]?[^\W\dA-Z_]{0,18}", span):  # a word of prose, as after "the secret:"
            against = -1
        hexed = bool(re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", span))
        return [1 if hexed or re.match(r"(?:AKIA|ghp_|gho_|sk-|sk_|xox[bap]-|AIza|eyJ)", span) else 0, 1 if entropy(span) >= 3.2 or _MIXED.fullmatch(span) else -1, 1 if _KEYWORD.search(before) or _KEYWORD.search(_ASSIGN.sub("", before)) else 0, 1 if _ASSIGN.search(before) else -1 if not before[-1:].isspace() and before else 0, against]
    if kind == "ssn":
        a, b, c = span.split("-")
        return [1, -1 if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else 1, 0, 1 if re.search(r"(?i)(?:ssn|social|security)\W*(?:\w+\W+)?$", before) else 0, against]
    flat = span.replace(" ", "")
    return [1 if 15 <= len(flat) <= 34 else -1, 1 if mod97(flat) else -1, 1 if _IBAN.get(flat[:2]) == len(flat) else -1 if flat[:2] in _IBAN else 0, 1 if _PAY.search(before) else 0, against]


def pattern(kind: str, span: str, before: str, after: str) -> int:
    """Votes, two bits each, then features, one bit each."""
    v, out = votes(kind, span, before, after), 0
    for x in v:
        out = out * 4 + x + 1
    for x in features(kind, span, before, after, v):
        out = out * 2 + x
    return out


def unpacked(pattern: int) -> tuple[list[int], list[int]]:
    bits = [pattern >> k & 1 for k in range(FEATURES - 1, -1, -1)]
    rest = pattern >> FEATURES
    return [(rest >> 2 * k & 3) - 1 for k in range(len(LABELERS) - 1, -1, -1)], bits


def features(kind: str, span: str, before: str, after: str, v: list[int]) -> list[int]:
    """Of the final classifier; all of them 0 or 1, so that spans fall into few patterns."""
    digits = re.sub(r"\D", "", span)
    checked = {"card": luhn(digits) if digits else False, "iban": kind == "iban" and v[1] == 1}.get(kind, v[1] == 1)
    return [int(checked), int(v[0] == 1), int(v[2] == 1), int(v[2] == -1), int(v[3] == 1), int(v[4] == -1), int(before[-1:].isspace() or not before), int(after[:1].isspace() or not after), int(len(span) >= 16)]


def proposals(text: str) -> Iterator[tuple[str, int, int, str, str]]:
    for m in PROPOSE.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        if kind == "keyed":
            quoted = next(g for g in ("double", "single", "back", "bare") if m[g] is not None)
            a, b = m.span(quoted)
            if quoted == "bare":
                while b > a and text[b - 1] in ".,;:!?)]}>":
                    b -= 1
            if b == a:
                continue
            yield "secret", a, b, text[max(0, a - 24) : a], text[b : b + 2]
            continue
        while kind != "pem" and b > a and text[b - 1] in ".-":
            b -= 1
        yield "secret" if kind == "pem" else kind, a, b, text[max(0, a - 24) : a], text[b : b + 2]


_DIGIT = re.compile(r"[\d@]")
_FORM = re.compile("gh[pousr]_")
_HEX = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){6}")
#: Each key word of PROPOSE has one of these, in small letters.
_STEMS = ("passw", "passphrase", "pwd", "token", "secret", "key", "auth", "credential", "bearer")


def may_have(text: str) -> bool:
    """Whether PROPOSE can match anywhere: each of its branches asks for a digit (of any script), an @, two colons, six groups of hex digits, AKIA or a key word."""
    if _DIGIT.search(text) or "::" in text or "AKIA" in text or "gh" in text and _FORM.search(text) or "xox" in text or ("ſ" in text or "\u212a" in text):  # the last two are S and K to a pattern without case
        return True
    small = text.lower()
    return any(s in small for s in _STEMS) or (text.count(":") > 5 and _HEX.search(text) is not None)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, span, pattern: the votes and features as one number) of all proposed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if may_have(t):
                    rows += [(i, k, x, y, pattern(k, t[x:y], p, q)) for k, x, y, p, q in proposals(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "kind", "start", "end", "pattern"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return d.mapInArrow(run, "doc_id long, kind string, start int, end int, pattern int")


def reliabilities(votes: np.ndarray, n: np.ndarray, check_digits: bool = False, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns with their counts: (probability of each pattern, table [class, labeler, vote + 1], share of the true class). It starts from the majority of the votes. check_digits: the labeler "check" computes them, so that, before any data, its votes against are taken to be right but for one in a thousand, with ten times the weight of the data."""
    s = votes.sum(1)
    p = np.where(s > 0, 0.9, np.where(s < 0, 0.1, 0.5))
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    # before any data each labeler is right more often than wrong when it votes; so a kind with one class only keeps it
    prior = np.repeat(np.array([[4.0, 3.0, 1.0], [1.0, 3.0, 4.0]])[:, None, :], votes.shape[1], 1)
    if check_digits:
        prior[1, 1] = np.array([0.001, 0.001, 0.998]) * (1000 + 10 * n.sum())
    for _ in range(rounds):
        w = np.stack([(1 - p) * n, p * n])
        table = np.einsum("cp,plv->clv", w, onehot) + prior
        table /= table.sum(2, keepdims=True)
        share = (w[1].sum() + 1) / (n.sum() + 2)
        ll = np.einsum("plv,clv->cp", onehot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(ll[0] + np.log(1 - share) - ll[1] - np.log(share), -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, table, float(share)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the last for the constant, of a logistic regression on probabilities y with counts n, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * q * (1 - q))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (y - q)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def classifier(found: DataFrame) -> dict[str, dict[int, float]]:
    """For each kind the probability of each pattern that occurs."""
    counts = found.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, dict[int, float]] = {}
    for kind in KINDS:
        rows = sorted((r.pattern, r.n) for r in counts if r.kind == kind)
        if rows:
            both = [unpacked(p) for p, _ in rows]
            v, x, n = np.array([b[0] for b in both]), np.array([b[1] for b in both]), np.array([k for _, k in rows], float)
            soft, _, _ = reliabilities(v, n, kind in CHECK_DIGITS)
            w = logistic(x, soft, n)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            out[kind] = {r[0]: round(float(q), 6) for r, q in zip(rows, p, strict=True)}
    return out


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, probability, is_private) of all proposed spans of all documents; is_private: 0.5 or more."""
    common.small_batches(docs.sparkSession)
    found = common.stored(candidates(docs), "spans")
    table = [(k, p, q) for k, ps in classifier(found).items() for p, q in ps.items()]
    scored = found.join(F.broadcast(docs.sparkSession.createDataFrame(table or [("", 0, 0.0)], "kind string, pattern int, probability double")), ["kind", "pattern"])
    return scored.select("doc_id", "kind", "start", "end", "probability", (F.col("probability") >= 0.5).alias("is_private"))


def masked(docs: DataFrame) -> DataFrame:
    """docs, all columns, with each private span of the text replaced by <KIND>, and n_chars, where there is such a column, brought up to date for the texts that change."""
    common.small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(classifier(common.stored(candidates(docs), "spans")))
    names = docs.columns
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str | None] = []
            changed = False
            for s in b.column(at).to_pylist():
                if s and may_have(s):
                    out, last = [], 0
                    for k, x, y, p, q in proposals(s):
                        if table.value.get(k, {}).get(pattern(k, s[x:y], p, q), 0.0) >= 0.5:
                            out += [s[last:x], f"<{k.upper()}>"]
                            last = y
                    if out:
                        s, changed = "".join([*out, s[last:]]), True
                texts.append(s)
            if changed:
                new = pa.array(texts, b.column(at).type)
                arrays = list(b.columns)
                if n_at >= 0:
                    arrays[n_at] = pa.array([n if old.as_py() == s or s is None else len(s) for n, old, s in zip(b.column(n_at).to_pylist(), b.column(at), texts, strict=True)], b.column(n_at).type)
                arrays[at] = new
                b = pa.RecordBatch.from_arrays(arrays, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
