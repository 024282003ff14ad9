"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap: the four base patterns with their checks (e-mail, IP address, card
number, phone number), numbers that miss a check, numbers grouped like a phone number or 3-2-4, addresses spelled out with
marks or words, values that something is assigned to, and bare long mixed tokens. Base spans always stay. Every other
candidate is judged by boosted trees on features of its format and its context; a threshold per kind, calibrated by
cross-fitting to the precision ``PRECISION``, selects which are added, best first, where they overlap no base span and no
better one. Candidates that the cues speak against (``_label`` 0) are never added; a kind whose examples the trees can't tell
apart with that precision, or that has none, adds nothing.

The trees learn from weak labels: cues of shape and of context must agree (``_label``). Phone and card numbers that passed
the base checks are examples of the shapes of contacts and numbers, with the features of those checks hidden. The words that
make a label are hidden from half of the training candidates, so that the shape of a value counts by itself. Bins, trees and
thresholds come from all labelled candidates (``trees``): tasks add them up, none comes to the driver. Candidates are found
and described in one pass over the texts, kept in a table, and scored from it.

Offsets are code points, ends are exclusive. Null and empty texts have no spans, long texts are read whole, repeated rows are
judged alike, an empty table gives no rows. Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_counts
from . import base, trees
from .trees import FOLDS, Trees

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("contact", "number", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
PRECISION = 0.98
CONTEXT = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUPED = re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_RUN = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63} ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,10}")
_ASSIGNED = re.compile(r"[=:][\x20\t]*[\"']?(?!//)([A-Za-z0-9_./+-]{12,})")
_NAMES = re.compile(r"(?i)(?:token|secret|passw|pwd|api|key|auth|credential)[A-Za-z_]*[\"']?[\x20\t]*[=:]?[\x20\t]*[\"']?$")

_SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} at [A-Za-z0-9-]{2,63}(?: dot [A-Za-z0-9-]{2,63}){0,2} dot [a-z]{2,6}(?![A-Za-z0-9-])")
_GROUPS_324 = re.compile(r"(?<![0-9-])[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![0-9-])")
_BARE = re.compile(r"(?<![A-Za-z0-9_./+=-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,64}(?![A-Za-z0-9_./+=-])")
_PHONE_SHAPE = re.compile(r"(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}")
_WORDS = re.compile(r"[a-z]{4,}")
_TIGHT = re.compile(r"(?:\[dot\]|\(dot\))|[A-Za-z0-9]\.[a-z]{2,10}$")
_FOURS = re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?")
_CONTACT = re.compile(r"(?i)\b(?:call|phone|tel|telephone|fax|mobile|cell|contact|reach|whatsapp|sms|dial|e-?mail|mail|write to|tel[eé]fono|ll[aá]me\w*|llamar|m[oó]vil|t[eé]l[eé]phone|appele[rz]|telefon|handy|anruf\w*|kontakt)\b")
_PAID = re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|iban|bank|ssn|passport|tarjeta|carte|karte|konto)\b")
_OTHER = re.compile(r"(?i)\b(?:order|invoice|isbn|issn|id|ids|serial|sku|ref|reference|version|build|timestamp|part|ticket|tracking|commit|sha|sha1|sha256|md5|hash|checksum|digest|uuid|revision|file|row|line|page|pedido|factura|commande|facture|bestellung|rechnung)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, ordered by kind as listed and by start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """What the high-recall generators propose besides."""
    out = [("number", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 9]
    seen = set(out)
    out += [s for m in _RUN.finditer(text) if (s := ("number", *m.span())) not in seen]
    out += [("contact", *m.span()) for m in _GROUPED.finditer(text)]
    out += [s for m in _GROUPS_324.finditer(text) if (s := ("number", *m.span())) not in seen]
    if "[at]" in text or "(at)" in text:
        out += [("contact", *m.span()) for m in _SPELLED.finditer(text)]
    if " at " in text and " dot " in text:
        out += [("contact", *m.span()) for m in _SPOKEN.finditer(text)]
    assigned = [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)] if "=" in text or ":" in text else []
    known = set(assigned)
    return out + assigned + [s for m in _BARE.finditer(text) if (s := ("secret", *m.span())) not in known]


def checked_spans(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans whose checks vouch for their shape, as examples of the added kinds; what was checked is hidden from them."""
    return [({"phone": "contact", "card": "number"}[k], s, e) for k, s, e in found if k in ("phone", "card")]


#: Features of a candidate, in order; the last ``NAMING`` are of words nearby and can be hidden.
FEATURES = (
    "kind length digits letters upper distinct entropy separators groups luhn at_sign dots hex before_space before_mark "
    "after_space after_mark start_share context_digits context_upper assigned plus spelled area fours groups_324 phone_shape mixed words glued other_word contact_word paid_word named named_near"
).split()
#: Features of the checks that make base spans; hidden from examples that come from them.
CHECKS = ("luhn", "plus", "at_sign")
NAMING = 4


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    n = len(span)
    digits = [c for c in span if "0" <= c <= "9"]
    counts = np.unique(list(span), return_counts=True)[1] / n
    named = _NAMES.search(before)
    return [
        float(KINDS.index(kind)),
        float(n),
        len(digits) / n,
        sum(map(str.isalpha, span)) / n,
        sum(map(str.isupper, span)) / n,
        len(set(span)) / n,
        float(-(counts * np.log2(counts)).sum()),
        sum(c in " -.()" for c in span) / n,
        float(len(re.findall(r"[0-9]+", span))),
        float(len(digits) >= 9 and luhn("".join(digits))),
        float("@" in span or "at" in span),
        float(span.count(".")),
        float(all(c in "0123456789abcdefABCDEF" for c in span)),
        float(before[-1:].isspace() or not before),
        float(bool(before) and not before[-1].isspace() and not before[-1].isalnum()),
        float(after[:1].isspace() or not after),
        float(bool(after) and not after[0].isspace() and not after[0].isalnum()),
        start / max(1, len(text)),
        sum(map(str.isdigit, before + after)) / max(1, len(before + after)),
        sum(map(str.isupper, before + after)) / max(1, len(before + after)),
        float("=" in before or ":" in before),
        float(before[-1:] == "+" or "+" in before[-4:]),
        float(_is_spelled(span)),
        float(_has_area(span)),
        float(_FOURS.fullmatch(span) is not None),
        float(_GROUPS_324.fullmatch(span) is not None),
        float(_PHONE_SHAPE.fullmatch(span.lstrip("+")) is not None),
        float(any(map(str.isupper, span)) + any(map(str.islower, span)) + bool(digits)),
        sum(map(len, _WORDS.findall(span))) / n,
        float(_is_glued(before, after)),
        float(_OTHER.search(before) is not None),
        float(_CONTACT.search(before + " " + after) is not None),
        float(_PAID.search(before) is not None),
        float(named is not None),
        float(bool(re.search(r"(?i)token|secret|passw|key", before))),
    ]


def _is_spelled(span: str) -> bool:
    return "[at]" in span or "(at)" in span or " at " in span and " dot " in span


def _has_area(span: str) -> bool:
    return "(" in span and ")" in span and not _is_spelled(span)


def _is_glued(before: str, after: str) -> bool:
    """Within a longer token: a letter, digit or a mark of paths and names next to it."""
    return bool(before) and (before[-1].isalnum() or before[-1] in "_/") or bool(after) and (after[0].isalnum() or after[0] in "_/")


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.float32()))])
_FOUND = "doc_id long, content long, base array<struct<kind:string,start:long,end:long>>, candidates array<struct<kind:string,start:long,end:long,label:int,features:array<float>>>"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, values in base.pieces(batches):
        all_base, all_loose = [], []
        for value in values:
            text = value.decode("utf-8", "surrogatepass")
            found = base_spans(text)
            taken = _Taken([(s, e) for _, s, e in found])
            run_on = _Taken([m.span() for m in _PHONE.finditer(text) if sum(map(str.isdigit, m.group())) > 15])
            loose = []
            for kind, s, e in loose_spans(text):
                x = describe(text, kind, s, e)
                loose.append({"kind": kind, "start": s, "end": e, "label": -1 if taken.hit(s, e) or run_on.hit(s, e) else _label(kind, text[s:e], x), "features": x})
            for kind, s, e in checked_spans(found):
                x = describe(text, kind, s, e)
                against = x[FEATURES.index("glued")] or x[FEATURES.index("other_word")]
                hidden = [0.0 if f in CHECKS else v for f, v in zip(FEATURES, x)]
                loose.append({"kind": kind, "start": s, "end": e, "label": -1 if against else 1, "features": hidden})
            all_base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            all_loose.append(loose)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), base.contents(values), pa.array(all_base, pa.list_(_SPAN)), pa.array(all_loose, pa.list_(_CANDIDATE))], ["doc_id", "content", "base", "candidates"]
        )


def _label(kind: str, span: str, features: list[float]) -> int:
    """1, 0, or -1 where the cues don't agree, for a candidate off the base spans.

    Cues for: the shape is one of the kind's, and words nearby (or the name that it is assigned to) say so. Cues against:
    words of other numbers, a longer token around it, words inside it. Both cues for and none against make a positive, as do
    two marks of spelled-out addresses and groups of 3-2-4 digits; cues against and not both for make a negative.
    """
    x = dict(zip(FEATURES, features))
    n = round(x["digits"] * x["length"])
    against = bool(x["glued"] or x["other_word"])
    if kind == "secret":
        shape = x["length"] >= 20 and x["mixed"] >= 2 and x["entropy"] > 3.5 and x["words"] < 0.3
        context = bool(x["named"])
        against = against or x["words"] > 0.6 or x["entropy"] < 2.5
    elif kind == "contact":
        shape, context = bool(x["spelled"] or x["area"] or x["phone_shape"]), bool(x["contact_word"])
        if x["spelled"] and _TIGHT.search(span) or _SPOKEN.fullmatch(span):
            return -1 if against else 1
    else:
        shape = bool(13 <= n <= 19 and x["fours"] or n == 9 and x["groups_324"] or 9 <= n <= 15 and x["phone_shape"])
        context = bool(x["paid_word"] or x["contact_word"] or x["named"]) and 9 <= n <= 19
        if x["groups_324"] and n == 9:
            return 0 if against else 1
        if not shape and not context:
            return 0
    if shape and context:
        return -1 if against else 1
    if context and kind != "contact" and not against:
        return 1 if kind == "secret" or 13 <= n <= 19 else -1
    return 0 if against else -1


class _Taken:
    """Whether a span overlaps one of a set of spans, by a search in their merged order."""

    def __init__(self, spans: list[tuple[int, int]]):
        merged: list[list[int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        self.starts, self.ends = [m[0] for m in merged], [m[1] for m in merged]

    def hit(self, start: int, end: int) -> bool:
        i = int(np.searchsorted(self.ends, start, "right"))
        return i < len(self.starts) and self.starts[i] < end


class Detector:
    def __init__(self, trees: Trees | None, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def added(self, taken: list[tuple[int, int]], candidates: list[dict]) -> list[tuple[str, int, int]]:
        """Candidates to add, best first, without overlaps; ties go to the earlier and longer span."""
        if self.trees is None or not candidates:
            return []
        p = self.trees.scores(np.array([c["features"] for c in candidates], np.float64))
        order = sorted(range(len(candidates)), key=lambda i: (-p[i], candidates[i]["start"], -candidates[i]["end"], candidates[i]["kind"]))
        fixed, chosen, out = _Taken(taken), [], []
        for i in order:
            c = candidates[i]
            if c["label"] != 0 and p[i] >= self.thresholds[c["kind"]] and not fixed.hit(c["start"], c["end"]):
                chosen.append((c["kind"], c["start"], c["end"]))
        starts: list[int] = []
        ends: list[int] = []
        for kind, s, e in chosen:
            i = bisect.bisect_right(ends, s)
            if i == len(starts) or starts[i] >= e:
                starts.insert(i, s)
                ends.insert(i, e)
                out.append((kind, s, e))
        return out


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def _selector(shared):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector: Detector = shared.value
        for batch in batches:
            rows = []
            for doc, content, found, candidates in zip(*(batch.column(i).to_pylist() for i in range(4))):
                mine = [(b["kind"], b["start"], b["end"]) for b in found]
                counts = [sum(k == kind for k, _, _ in mine) for kind in BASE_KINDS]
                more = detector.added([(s, e) for _, s, e in mine], candidates)
                rows.append((doc, *counts, hashlib.sha256(_line(mine).encode()).hexdigest(), _line(mine + more), len(more), len(mine) + len(more), content))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 10, kinds)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans", "content"],
            )

    return select


def fit(found: DataFrame) -> Detector:
    """A detector from all labelled candidates of the table that ``propose`` made.

    A kind with more candidates than the others together weighs as much as they do. Equal candidates of equal texts are in one
    fold.
    """
    place = F.pmod(F.xxhash64("content", "start", "end", "kind"), F.lit(2 * FOLDS))
    rows = found.select("content", F.explode("candidates").alias("c")).select("content", "c.*").filter("label >= 0")
    rows = rows.select("kind", F.col("label").alias("y"), (place % FOLDS).cast("int").alias("fold"), (place >= FOLDS).alias("hidden"), "features")
    counts = [tuple(r) for r in rows.groupBy("kind", "fold", "y").count().orderBy("kind", "fold", "y").collect()]
    if len({y for _, _, y, _ in counts}) < 2:
        return Detector(None, dict.fromkeys(ADDED_KINDS, math.inf))
    sizes = {kind: sum(c[3] for c in counts if c[0] == kind) for kind in ADDED_KINDS if any(c[0] == kind for c in counts)}
    n = sum(sizes.values())
    weights = {kind: min(1.0, (n - size) / size) if size < n else 1.0 for kind, size in sizes.items()}
    models, state = trees.fit(rows, weights, counts, NAMING)
    return Detector(models[FOLDS], cut_scores(trees.unseen(state, models, list(sizes))))


def cut_scores(scored: DataFrame) -> dict[str, float]:
    """Per kind the lowest score p, 0.5 at least, from which on the share ``PRECISION`` of all rows has label 1."""
    share = round(1000 * PRECISION)
    surplus = F.sum(F.when(F.col("y") == 1, 1000 - share).otherwise(-share)).cast("long")
    per = scored.groupBy("kind", "p").agg(surplus.alias("surplus"))
    whole = dict(per.groupBy("kind").agg(F.sum("surplus")).collect())
    before = {kind: sum(whole[k] for k in whole if k < kind) for kind in whole}
    upto = F.col("_upto") - F.coalesce(*(F.when(F.col("kind") == k, F.lit(b)) for k, b in before.items()))
    found = dict(running_counts(per, [F.col("kind"), F.col("p").desc()], "surplus").filter(upto >= 0).groupBy("kind").agg(F.min("p")).collect())
    return {k: max(0.5, found[k]) if k in found else math.inf for k in ADDED_KINDS}


def propose(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and described candidates of every text."""
    return base.stored(base.texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_propose, _FOUND), "candidates")


def report(docs: DataFrame) -> DataFrame:
    found = propose(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(found))
    return found.mapInArrow(
        _selector(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long, content long"
    )


def masked(text: str | None, spans: str | None) -> str | None:
    """A text with its spans replaced by their kinds in brackets; spans that overlap go together, under the first one's kind."""
    found = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in (spans or "").split(",") if x))
    joined: list[list] = []
    for s, e, k in found:
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], -e)
        else:
            joined.append([s, -e, k])
    for s, e, k in reversed(joined):
        text = f"{text[:s]}[{k}]{text[e:]}"
    return text


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [masked(text, spans) for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row's doc_id and its text with each span of ``report`` replaced by its kind in brackets.

    Rows meet their spans by id and content, so null and repeated ids get those of their own text; null stays null.
    """
    rows = base.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("r")
    found = spans.select("doc_id", "content", "spans").dropDuplicates(["doc_id", "content"]).alias("s")
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64(F.coalesce("r.text", F.lit(""))) == F.col("s.content"))
    return rows.join(found, same, "left").select("r.doc_id", "r.text", "s.spans").mapInArrow(_mask, "doc_id long, text string")
