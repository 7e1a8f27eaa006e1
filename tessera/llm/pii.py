"""Operator 3: personal data by candidate gradient boosting, in DataFrame functions only.

Four base patterns (e-mail, IPv4, card and phone) give spans that always stay. Generators of high recall propose more:
written-out addresses, grouped numbers, long digit runs, IPv6 addresses and bank accounts. Boosted trees over the
candidates' format and context, evaluated as expressions, give a probability; a threshold for each kind, calibrated on
held-out candidates for the precision asked for, selects what is reported or redacted. Selected candidates then compete:
one that overlaps a base span, or a candidate of a larger margin over its threshold (of equal ones the earlier kind, then
the earlier start), goes.

The trees are fitted once for each session on ``TRAIN_ROWS`` generated sentences and ``MAIL_ROWS`` more with written-out
addresses of mixed forms and prose that looks like them (fixed bounds and seed), whose
candidates go through the same expressions; a candidate is a true one only where it begins with the datum that was put
in, so pieces of it and runs inside hashes, tokens and keys count as false. Nothing else is sampled. The scan is one narrow pass without an exchange.

Defined cases: a null text is an empty one; each row is scanned by itself, so null, repeated or clashing ids don't
matter; spans are in code points, end exclusive, and don't overlap within a kind.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.boosting import Boosted, fit, least_threshold
from tessera.llm.spans import SPAN, cut_spans, find_spans, join_spans, let, merge_spans

BASE = ("email", "ip", "card", "phone")
ADDED = ("written_email", "number_group", "digit_run", "ipv6", "iban")
TRAIN_ROWS, MAIL_ROWS, SEED, PRECISION = 3000, 1000, 11, 0.97

#: The base patterns; a look-behind and possessive runs make no difference to what they match, they only
#: keep long runs from being tried at each of their characters.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

_WRITTEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,40}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,40}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z]{2,12}"
_GROUPS = r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,5}(?![0-9A-Za-z])"
_RUN = r"(?<![0-9])[0-9]{8,19}(?![0-9])"
_IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
_IBAN = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"

_CALL = r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|handy|appel|llama|sms|ring)"
_OWN = r"(?i)\b(?:ssn|social|passport|account|iban|card|konto|ausweis|compte|cuenta|licen[cs]e|patient|member|mail|contact|write|reach)"
_THING = r"(?i)\b(?:order|invoice|isbn|page|version|part|item|total|sum|code|article|sku|ticket|build|no|nr|date|time|year|room|score|between)\b"
_PLAIN = r"(?i)^(?:i|me|us|we|you|he|she|they|them|him|her|it|this|that|be|is|are|was|were|been|look|looks|looked|looking|met|meet|here|there|home|stays?|stayed|arrives?|arrived|works?|worked|and|or|not|all|day|time|one)\x20at\x20"
FEATURES = ("kind", "digits", "length", "separators", "call", "own", "thing", "glued_before", "glued_after", "zero", "upper", "three_two_four", "dashes", "bracketed", "sentence_end", "capital_end", "plain_word")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_spans(text: Column) -> list[Column]:
    """Spans of the four base kinds."""
    email = find_spans(text, _EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(find_spans(text, _IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: s.txt.rlike(_IP_PARTS))
    card = F.filter(find_spans(text, _CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")), lambda s: (F.length(_digits(s.txt)) <= 19) & F.call_function("luhn_check", _digits(s.txt)))
    phone = F.filter(find_spans(text, _PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s.txt)).between(10, 15))
    return [email, ip, card, phone]


def _card_itself(txt: Column) -> Column:
    return F.length(_digits(txt)).between(14, 19) & F.call_function("luhn_check", _digits(txt))


def candidate_spans(text: Column) -> list[Column]:
    """Spans proposed by each generator."""
    has = lambda s: F.contains(text, F.lit(s))
    written = find_spans(text, _WRITTEN, has("[at]") | has("(at)") | has(" at "))
    groups = F.filter(find_spans(text, _GROUPS, text.rlike(r"[0-9]{2}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{2}")), lambda s: ~_card_itself(s.txt) & ~s.txt.rlike(_IP_PARTS) & ~s.before.rlike(r"\+[0-9][\x20().0-9-]*$"))
    runs = F.filter(find_spans(text, _RUN, text.rlike("[0-9]{8}")), lambda s: ~_card_itself(s.txt) & ~s.before.rlike(r"(?:\+|[0-9][\x20.-])$") & ~s.after.rlike(r"^[\x20.-][0-9]"))
    ipv6 = find_spans(text, _IPV6, has(":") & text.rlike("(?:[0-9A-Fa-f]{1,4}:){4}"))
    iban = find_spans(text, _IBAN, text.rlike("[A-Z]{2}[0-9]{2}"))
    return [written, groups, runs, ipv6, iban]


def candidate_features(span: Column, kind: int) -> list[Column]:
    """Format and context of a candidate, as numbers in the order of FEATURES."""
    flag = lambda c: c.cast("double")
    number = lambda c: c.cast("double")
    return [
        F.lit(float(kind)),
        number(F.length(_digits(span.txt))),
        number(F.length(span.txt)),
        number(F.length(F.regexp_replace(span.txt, "[0-9A-Za-z]", ""))),
        flag(span.before.rlike(_CALL)),
        flag(span.before.rlike(_OWN)),
        flag(span.before.rlike(_THING)),
        flag(span.before.rlike(r"[A-Za-z0-9$#_/=.-]$")),
        flag(span.after.rlike(r"^[A-Za-z0-9%_/=-]")),
        flag(span.txt.startswith("0")),
        number(F.length(F.regexp_replace(span.txt, "[^A-Z]", ""))),
        flag(span.txt.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        number(F.length(F.regexp_replace(span.txt, "[^-]", ""))),
        flag(span.txt.rlike(r"[\[(](?:at|dot)[\])]")),
        flag(span.txt.rlike(r"[^\x20]\.\x20[A-Za-z]+$")),
        flag(span.txt.rlike(r"[\x20.][A-Z][A-Za-z]*$")),
        flag(span.txt.rlike(_PLAIN)),
    ]


def _sentences() -> list[tuple[int, str, str, float]]:
    """(number, sentence, datum, label): generated sentences with one candidate each; # stands for a digit, ? for a hex digit, ~ for a word."""
    pick = random.Random(SEED)
    lead = ["Please {c} {x} today", "{c} {x}.", "We had {c} {x} on file", "La {c}: {x} est", "Die {c} {x} ist neu", "mi {c} {x}, gracias"]
    good = [
        (["call", "phone", "my mobile", "Telefon", "tel", "fax", "cell"], ["(###) ###-####", "###-###-####", "### ### ####", "#### ### ###", "## ## ## ## ##", "###.###.####"]),
        (["SSN", "social security", "passport", "member"], ["###-##-####", "########", "#########"]),
        (["account", "Konto", "compte", "cuenta", "patient", "card"], ["##########", "############", "####-####-####"]),
        (["write to", "contact", "reach me", "mail"], ["ann.lee [at] mail [dot] com", "joe(at)site(dot)org", "max at host dot de", "eva [at] post.example.com"]),
        (["host", "from", "client", "address"], ["2001:db8:?:?:?:?:?:?", "fe80:?:?:?:?:?:?:?"]),
        (["IBAN", "account", "pay to", "from"], ["DE## #### #### #### #### ##", "FR##################", "ES## #### #### #### #### ####"]),
    ]
    bad = [
        (["order", "invoice", "ticket", "part", "article", "sku", "no"], ["###-###-####", "##########", "####-####-####", "########", "###-##-####", "## ## ##"]),
        (["isbn", "code", "version", "build"], ["978-##-####-###", "##.##.##", "########", "############"]),
        (["the", "and", "le", "der", "of on", "ciones"], ["################", "#############", "## ## ##", "####-##-##", "########", "### ### ###"]),
        (["token", "hash", "commit", "key", "id", "account", "card", "member"], ["?c?########?b?", "a?f##########d?e", "0x########", "x-##########k", "id_#########", "#########ab?f", "/########/", "################"]),
        (["date", "between", "year", "score"], ["20##-##-##", "##-##-##", "20## 20## 20##", "##.##.20##"]),
        (["look", "we were", "met"], ["us at home dot dot", "them at noon . Then"]),
        (["time", "at", "log"], ["##:##:##:##:##", "#:#:#:#:#"]),
        (["part", "code", "model"], ["AB## #### ####", "XK######## ####", "ID##ABCDEFGHIJ"]),
    ]
    mail_good = [
        (["write to", "contact", "reach me", "mail"], ["~ at ~.com", "~.~ at ~.org", "~ at ~ . net", "Ann at ~.com"]),
        (["write to", "contact", "from", "see", "ask"], ["~ at ~ [dot] com", "~ at ~ (dot) org", "~.~ at ~ (dot) de", "Joe at ~ [dot] net", "~ [at] ~.com", "~(at)~ dot org", "~ at ~ dot com", "~.~ at ~ dot de"]),
    ]
    mail_bad = [
        (["look", "we were", "met", "contact", "write to", "reach"], ["them at noon . Then", "~ at ~. Then", "~ at ~. We", "~ at ~.She", "us at ~. then", "me at ~.com", "them at ~.org", "it at ~. The"]),
        (["see", "hosted", "docs", "visit", "read"], ["~ at ~.com", "~ at ~.org", "files at ~.html", "~ at ~. and"]),
    ]
    out = []
    for i in range(TRAIN_ROWS + MAIL_ROWS):
        label = i % 2
        mail = i >= TRAIN_ROWS
        cues, forms = pick.choice((mail_good if mail else good) if label else (mail_bad if mail else bad))
        cue = pick.choice(cues) if pick.random() < 0.9 else pick.choice(["the", "a note", "then"])
        form = pick.choice(forms)
        text = "".join(pick.choice("0123456789") if c == "#" else pick.choice("0123456789abcdef") * pick.choice([1, 1, 2]) if c == "?" else "".join(pick.choice("etaoinshrdlucm") for _ in range(pick.randint(2, 9))) if c == "~" else c for c in form)
        out.append((i, pick.choice(lead).format(c=cue, x=text), text, float(label)))
    return out


_FITTED: dict[str, tuple[Boosted, tuple[float, ...], dict[str, float]]] = {}
_MAIL_TREES: dict[str, Boosted] = {}


def fitted(spark: SparkSession) -> tuple[Boosted, tuple[float, ...], dict[str, float]]:
    """(trees of the other kinds than written_email, threshold of each added kind, held-out precision and recall); fitted once for each session."""
    key = spark.sparkContext.applicationId
    if key not in _FITTED:
        rows = spark.createDataFrame(_sentences(), "i int, text string, datum string, label double")
        of_kind = [_described(spans, kind) for kind, spans in enumerate(candidate_spans(F.col("text")))]
        found = rows.select("i", "label", F.explode(F.concat(*of_kind)).alias("c")).select("i", (F.col("label") * F.col("c.whole").cast("double")).alias("label"), "c.f").orderBy("i").collect()  # at most a few for each of TRAIN_ROWS
        x, y, i = np.array([r.f for r in found]), np.array([r.label for r in found]), np.array([r.i for r in found])
        held = (i // 2) % 10 < 4
        mail = x[:, 0] == 0  # written-out addresses have trees of their own
        model, _MAIL_TREES[key] = (fit(x[~held & of], y[~held & of]) for of in (~mail, mail))
        p = np.where(mail, _MAIL_TREES[key].probability(x), model.probability(x))[held]
        cuts = []
        for kind in range(len(ADDED)):
            mine = x[held][:, 0] == kind
            cuts.append(least_threshold(p[mine], y[held][mine], PRECISION) if mine.any() else 1.01)
        chosen = p >= np.array(cuts)[x[held][:, 0].astype(int)]
        hits = float((chosen * y[held]).sum())
        _FITTED[key] = (model, tuple(cuts), {"precision": hits / max(1.0, float(chosen.sum())), "recall": hits / max(1.0, float(y[held].sum()))})
    return _FITTED[key]


def _described(spans: Column, kind: int) -> Column:
    """Features of the candidates of a generated sentence, and whether they begin with the datum put in."""
    return F.transform(spans, lambda s: F.struct(F.array(*candidate_features(s, kind)).alias("f"), F.startswith("datum", s.txt).alias("whole")))


_SCORED = "array<struct<start:int,end:int,txt:string,before:string,after:string,lead:double>>"


def _selected(spans: Column, kind: int, model: Boosted, cut: float) -> Column:
    """The spans whose probability reaches the kind's threshold, with their margin over it."""
    if cut > 1:
        return F.array().cast(_SCORED)
    cut = min(max(cut, 1e-9), 1 - 1e-9)
    least = float(np.log(cut / (1 - cut))) - 1e-9

    def scored(s: Column) -> Column:
        lead = let(F.array(*candidate_features(s, kind)), lambda f: model.column(lambda k: F.element_at(f, k + 1))) - least
        return F.struct(s.start.alias("start"), s.end.alias("end"), s.txt.alias("txt"), s.before.alias("before"), s.after.alias("after"), lead.alias("lead"))

    return F.filter(F.transform(spans, scored), lambda s: s.lead >= 0)


def _overlaps(s: Column, t: Column) -> Column:
    return (s.start < t.end) & (t.start < s.end)


def _unbeaten(kind: int) -> Column:
    """The kind's spans that no base span and no stronger span of another kind overlaps (of one kind, none overlap)."""

    def beats(s: Column, other: int) -> Column:
        least = (lambda t: t.lead >= s.lead) if other < kind else (lambda t: t.lead > s.lead)
        return F.exists(f"scored_{ADDED[other]}", lambda t: _overlaps(s, t) & least(t))

    def stays(s: Column) -> Column:
        beaten = F.exists(F.concat(*BASE), lambda t: _overlaps(s, t))
        for other in range(len(ADDED)):
            if other != kind:
                beaten = beaten | beats(s, other)
        return ~beaten

    none = F.array().cast(_SCORED)
    own = f"scored_{ADDED[kind]}"
    kept = F.when(F.size(own) > 0, F.filter(own, stays)).otherwise(none)
    return F.transform(kept, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "txt", "before", "after")))).cast(f"array<{SPAN}>")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with an array of spans (start, end, txt, before, after) for each kind of BASE and ADDED.

    Columns: doc_id, text (null as empty), then one for each kind.
    """
    model, cuts, _ = fitted(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    mail = _MAIL_TREES[docs.sparkSession.sparkContext.applicationId]
    added = [_selected(s, k, model if k else mail, cuts[k]).alias(f"scored_{ADDED[k]}") for k, s in enumerate(candidate_spans(text))]
    found = rows.select("doc_id", "text", *(s.alias(k) for k, s in zip(BASE, base_spans(text), strict=True)), *added)
    return found.select("doc_id", "text", *BASE, *(_unbeaten(k).alias(name) for k, name in enumerate(ADDED)))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans as text."""
    kinds = [*BASE, *ADDED]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(join_spans(list(BASE), [F.col(k) for k in BASE]), 256).alias("base_sha256"),
        join_spans(kinds, [F.col(k) for k in kinds]).alias("spans"),
    )


def redact_pii(docs: DataFrame, mark: str = "[PII]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, clean_text): every reported span, overlapping ones as one, replaced by ``mark``."""
    found = find_pii(docs, id_col, text_col).select("doc_id", "text", F.concat(*BASE, *ADDED).alias("all"))
    return found.select("doc_id", F.when(F.size("all") > 0, cut_spans(F.col("text"), merge_spans(F.col("all")), mark)).otherwise(F.col("text")).alias("clean_text"))
