"""Personal data by weak supervision, by SQL functions only.

Broad patterns propose candidate spans of each kind.  Five labelers vote on each, for, against or not at all: a strict
format (regex), a checksum or count of digits, a gazetteer (domains, calling codes, countries, street words, first names),
cue words in the context, and the span's borders.  Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is, starting from and held to a documented prior; its posteriors train a logistic classifier
of spans, which decides about the candidates that the base patterns leave open.  Only counts of patterns reach the
driver: at most 3^5 votes times the borders, lengths and proposing patterns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .spans import digest, find_spans, let

# Kinds in order, the base ones first, then patterns.  Runs are possessive and start where a run starts (or
# the last match ended), which gives the same matches as the plain patterns without their quadratic retries.
KINDS = ("email", "ip", "card", "phone", "bank", "street", "person")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
EMAIL_SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[({](?:at|AT)[\])}] ?| (?:at|AT) )[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?| (?:dot|DOT) )[A-Za-z0-9-]{1,63}+){1,4}"
IP_SIX = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]|\.[0-9])"
PHONE_LOCAL = r"(?<![0-9A-Za-z+.,/-])(?<![0-9] )\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z]|[ .,/-][0-9])"
BANK = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
STREET_WORDS = ("street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "boulevard", "blvd", "court", "square", "terrace", "rue", "allée", "chemin", "calle", "avenida", "plaza", "paseo", "straße", "strasse", "weg", "platz", "gasse", "allee")
STREET = (
    r"(?<![\p{L}\p{N}])(?:[0-9]{1,5}[a-z]?,? (?:[A-Z][\p{L}'-]{1,30} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square|Terrace)(?![\p{L}\p{N}])"
    r"|[0-9]{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|allée|chemin) (?:de la |de l'|du |des |de |d')?[A-Z][\p{L}'-]{1,30}(?: [A-Z][\p{L}'-]{1,30}){0,3}"
    r"|(?:Calle|Avenida|Plaza|Paseo) (?:de la |del |de )?[A-Z][\p{L}'-]{1,30}(?: [A-Z][\p{L}'-]{1,30}){0,2},? [0-9]{1,4}(?![0-9])"
    r"|[A-Z][\p{L}-]{1,30}(?:straße|strasse|weg|platz|gasse|allee) [0-9]{1,4}[a-z]?(?![\p{L}\p{N}]))"
)
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES})\.? |(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo) )[A-Z][\p{{L}}'-]{{1,30}}(?: [A-Z][\p{{L}}'-]{{1,30}}){{0,2}}"
LOCAL_FORMAT = r"^(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|\(?0[0-9]{1,4}\)?[ /-]{1,2}[0-9]{3,4}[ -]?[0-9]{3,5})$"
CARD_FORMAT = r"^(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})$"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "eu", "uk", "de", "fr", "es", "it", "nl", "pl", "ch", "at", "be", "ca", "au", "us", "jp", "in", "br", "se", "no", "dk", "fi", "pt", "cz", "ie", "mx", "ar", "cl", "co", "nz", "za", "kr", "cn")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "65", "81", "82", "86", "90", "91", "351", "352", "353", "358", "420")
BANK_COUNTRIES = ("AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IT", "LI", "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "TR")
FIRST_NAMES = ("anna", "antonio", "carlos", "carmen", "charles", "claire", "david", "elena", "elizabeth", "emma", "eva", "francisco", "hans", "ines", "james", "jean", "jennifer", "joe", "john", "jose", "juan", "julia", "karl", "klaus", "laura", "linda", "louis", "lucia", "luis", "manuel", "maria", "marie", "mark", "martin", "mary", "michael", "monika", "nicolas", "patricia", "paul", "peter", "pierre", "richard", "robert", "sabine", "sophie", "stefan", "susan", "thomas", "ursula", "william", "wolfgang")
CUES = {
    "email": ("mail", "contact", "write to", "kontakt", "correo", "courriel", "reach"),
    "ip": ("ip", "address", "host", "server", "client", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp", "telefon", "téléphone", "teléfono", "reach", "ring"),
    "bank": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer", "überweis", "virement"),
    "street": ("address", "live", "lives", "home", "ship to", "deliver", "wohn", "adresse", "anschrift", "habite", "domicilio", "dirección", "vivo"),
    "person": ("name", "signed", "contact", "patient", "customer", "dear", "regards", "herr", "frau", "madame", "señor"),
}
AGAINST = ("version", "isbn", "order no", "order number", "serial", "sku", "invoice", "part no", "model", "v.", "§")
CONTEXT = 40
LABELERS = ("pattern", "check", "gazetteer", "context", "borders")
FEATURES = (*LABELERS, "before", "after", "size", "form")
LEVELS = {**dict.fromkeys(LABELERS, 3), "before": 4, "after": 4, "size": 4, "form": 2}
#: Prior chances of a vote against, none and for, given a true span and a false one, and how many times the candidates
#: they weigh.  A failed checksum all but rules a span out, and words against it nearly so, whatever the others agree on.
PRIOR, PRIOR_WEIGHT = {True: (0.06, 0.24, 0.7), False: (0.5, 0.35, 0.15)}, 0.5
PRIOR_CONTEXT = {True: (0.01, 0.49, 0.5), False: (0.4, 0.5, 0.1)}
PRIOR_CHECK, CHECK_WEIGHT = {True: (0.0005, 0.1995, 0.8), False: (0.85, 0.1, 0.05)}, 10.0


def _vote(yes: Column, no: Column | None = None) -> Column:
    """2 for, 0 against, 1 abstains."""
    out = F.when(yes, F.lit(2))
    return (out.when(no, F.lit(0)) if no is not None else out).otherwise(F.lit(1))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _side(c: Column) -> Column:
    """0: edge of the text, 1: blank, 2: letter or digit, 3: anything else."""
    return F.when(c == "", 0).when(F.rlike(c, F.lit(r"^\s$")), 1).when(F.rlike(c, F.lit(r"^[\p{L}\p{N}]$")), 2).otherwise(3)


def _candidate(text: Column, s: Column, kind: str, base: Column, votes: dict[str, Column], form: int = 0) -> Column:
    """A candidate with the votes on it; ``form``: 1 if a pattern other than a base one proposed it."""
    start = F.greatest(s["start"] - CONTEXT, F.lit(0))
    near = F.lower(F.substring(text, (start + 1).cast("int"), (s["start"] - start).cast("int")))
    cue, against = F.lit(False), F.lit(False)
    for word in CUES[kind]:
        cue = cue | near.contains(word)
    for word in AGAINST:
        against = against | near.contains(word)
    before = F.when(s["start"] > 0, F.substring(text, s["start"].cast("int"), F.lit(1))).otherwise(F.lit(""))
    after = F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))
    return let(F.struct(_side(before).alias("before"), _side(after).alias("after")), lambda side: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), base.alias("base"),
        *(votes[n].alias(n) for n in ("pattern", "check", "gazetteer")), F.when(against, 0).when(cue, 2).otherwise(1).alias("context"),
        F.when((side["before"] == 2) | (side["after"] == 2), 0).otherwise(2).alias("borders"),
        side["before"].alias("before"), side["after"].alias("after"),
        F.when(s["end"] - s["start"] < 10, 0).when(s["end"] - s["start"] < 16, 1).when(s["end"] - s["start"] < 24, 2).otherwise(3).alias("size"), F.lit(form).alias("form"),
    ))


def _bank_check(number: Column) -> Column:
    """Whether a bank number without blanks has remainder 1 by 97, its first four signs last and letters as 10 to 35."""
    turned = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("long")
    step = lambda acc, c: F.pmod(F.when(value(c) > 9, acc * 100 + value(c)).otherwise(acc * 10 + value(c)), F.lit(97))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0).cast("long"), step) == 1


def candidates(text: Column) -> Column:
    """All candidate spans of a text in order; ``base`` marks those that the base patterns and checks accept."""
    digits = F.rlike(text, F.lit("[0-9]"))
    yes, no, none, good = F.lit(True), F.lit(False), F.lit(1), F.lit(2)

    def emails(s):
        last = F.lower(F.element_at(F.split(s["text"], r"\."), -1))
        return _candidate(text, s, "email", yes, {"pattern": good, "check": _vote(F.rlike(last, F.lit("^[a-z]{2,}$")), yes), "gazetteer": _vote(last.isin(*TOP_DOMAINS))})

    def spelt(s):
        last, bracketed = F.lower(F.regexp_extract(s["text"], "([A-Za-z]*)$", 1)), F.rlike(s["text"], F.lit(r"[\[({]"))
        spoken = F.rlike(s["text"], F.lit(r"(?i) at [^ ]+(?: dot |\.)"))
        return _candidate(text, s, "email", no, {"pattern": _vote(bracketed | F.rlike(s["text"], F.lit("(?i) dot ")), ~spoken), "check": _vote(F.length(last).between(2, 24) & (bracketed | last.isin(*TOP_DOMAINS)), yes), "gazetteer": _vote(last.isin(*TOP_DOMAINS), yes)}, 1)

    def ips(s):
        valid = F.rlike(s["text"], F.lit(OCTETS))
        return _candidate(text, s, "ip", valid, {"pattern": none, "check": _vote(valid, yes), "gazetteer": _vote(F.rlike(s["text"], F.lit(r"^[1-9][0-9]{1,2}\.")), F.rlike(s["text"], F.lit(r"^0+[0-9]")))})

    def sixes(s):
        return _candidate(text, s, "ip", no, {"pattern": good, "check": _vote(F.rlike(s["text"], F.lit("[1-9A-Fa-f]")), yes), "gazetteer": _vote(F.rlike(s["text"], F.lit("^(?:2|3|[fF][cdeCDE])")))}, 1)

    def cards(s):
        def judged(d, valid):
            return _candidate(text, s, "card", valid, {"pattern": _vote(F.rlike(s["text"], F.lit(CARD_FORMAT))), "check": _vote(valid, yes), "gazetteer": _vote(F.rlike(d, F.lit("^[3-6]")), yes)})

        return let(_digits(s["text"]), lambda d: let(F.length(d).between(12, 19) & F.call_function("luhn_check", d), lambda valid: judged(d, valid)))

    def phones(s):
        valid = F.length(_digits(s["text"])).between(9, 15)
        code = F.lit(False)
        for n in CALLING_CODES:
            code = code | F.startswith(s["text"], F.lit(f"+{n}"))
        return let(valid, lambda v: _candidate(text, s, "phone", v, {"pattern": good, "check": _vote(v, yes), "gazetteer": _vote(code, yes)}))

    def local(s):
        d = _digits(s["text"])
        dated = F.rlike(s["text"], F.lit(r"^\(?(?:19|20)[0-9]{2}[ ./-]"))
        area = F.rlike(s["text"], F.lit(r"^\(|^0[1-9]|^[2-9][0-9]{2}[ .-][2-9]"))
        return _candidate(text, s, "phone", no, {"pattern": _vote(F.rlike(s["text"], F.lit(LOCAL_FORMAT)), yes), "check": _vote(F.length(d).between(9, 12) & ~dated, yes), "gazetteer": _vote(area, yes)}, 1)

    def banks(s):
        def judged(n):
            return _candidate(text, s, "bank", no, {"pattern": _vote(F.length(n).between(15, 34), yes), "check": _vote(F.length(n).between(15, 34) & _bank_check(n), yes), "gazetteer": _vote(F.substring(n, 1, 2).isin(*BANK_COUNTRIES), yes)}, 1)

        return let(F.translate(s["text"], " ", ""), judged)

    def streets(s):
        words = F.lower(s["text"])
        return _candidate(text, s, "street", no, {"pattern": good, "check": none, "gazetteer": _vote(F.arrays_overlap(F.split(words, r"[^\p{L}]+"), F.array(*(F.lit(w) for w in STREET_WORDS))) | F.rlike(words, F.lit("(?:straße|strasse|weg|platz|gasse|allee) [0-9]")))}, 1)

    def people(s):
        named = F.arrays_overlap(F.split(F.lower(s["text"]), r"[^\p{L}]+"), F.array(*(F.lit(w) for w in FIRST_NAMES)))
        said = F.rlike(s["text"], F.lit(r"^(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo) "))
        two = F.size(F.split(s["text"], " ")) >= 3
        return _candidate(text, s, "person", no, {"pattern": _vote(said | two, yes), "check": none, "gazetteer": _vote(named, ~said & ~two)}, 1)

    long_runs = lambda s: F.length(_digits(s["text"])).between(12, 19)
    enough = lambda s: F.length(_digits(s["text"])) >= 7
    at = F.rlike(text, F.lit(r"[\[({](?:at|AT)[\])}]| (?:dot|DOT) "))
    found = (
        F.transform(find_spans(text, EMAIL, text.contains("@")), emails),
        F.transform(find_spans(text, IP, digits), ips),
        F.transform(F.filter(find_spans(text, CARD, digits), long_runs), cards),
        F.transform(find_spans(text, PHONE, text.contains("+")), phones),
        F.transform(find_spans(text, EMAIL_SPELT, at), spelt),
        F.transform(find_spans(text, IP_SIX, text.contains(":")), sixes),
        F.transform(F.filter(find_spans(text, PHONE_LOCAL, digits), enough), local),
        F.transform(find_spans(text, BANK, digits), banks),
        F.transform(find_spans(text, STREET, digits), streets),
        F.transform(find_spans(text, PERSON), people),
    )
    return F.sort_array(F.concat(*found))


def label_model(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """EM for two classes and independent labelers: posterior of each vote pattern.

    A labeler's chances start from their prior, which stays in every estimate with its
    weight, so that a kind with few or one-sided candidates can't turn a labeler round.
    """
    total = sum(patterns.values())
    weigh = lambda chances, weight: [x * max(8.0, weight * total) for x in chances]
    own = {"check": (PRIOR_CHECK, CHECK_WEIGHT), "context": (PRIOR_CONTEXT, CHECK_WEIGHT)}
    held = [[weigh(own.get(name, (PRIOR,))[0][yes], own.get(name, (PRIOR, PRIOR_WEIGHT))[1]) for name in LABELERS] for yes in (True, False)]
    rates = [[[x / sum(row) for x in row] for row in table] for table in held]
    prior, post = 0.5, {}
    for _ in range(rounds):
        for p in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for i, v in enumerate(p):
                a, b = a + math.log(rates[0][i][v]), b + math.log(rates[1][i][v])
            post[p] = 1 / (1 + math.exp(min(700.0, max(-700.0, b - a))))
        prior = (sum(c * post[p] for p, c in patterns.items()) + 1) / (total + 2)
        for k, yes in enumerate((True, False)):
            table = [list(row) for row in held[k]]
            for p, c in patterns.items():
                for i, v in enumerate(p):
                    table[i][v] += c * (post[p] if yes else 1 - post[p])
            rates[k] = [[x / sum(row) for x in row] for row in table]
    return post


def train_classifier(rows: list[tuple[tuple[int, ...], int, float]], rounds: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> tuple[float, dict[str, list[float]]]:
    """Logistic regression over one-hot features by weighted gradient descent; rows: (features, count, posterior)."""
    weights, bias = {f: [0.0] * LEVELS[f] for f in FEATURES}, 0.0
    total = sum(c for _, c, _ in rows) or 1
    for _ in range(rounds):
        down, down_bias = {f: [penalty * w for w in weights[f]] for f in FEATURES}, 0.0
        for x, c, y in rows:
            z = bias + sum(weights[f][v] for f, v in zip(FEATURES, x))
            err = c / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            down_bias += err
            for f, v in zip(FEATURES, x):
                down[f][v] += err
        bias -= rate * down_bias
        for f in FEATURES:
            weights[f] = [w - rate * g for w, g in zip(weights[f], down[f])]
    return bias, weights


def fit(found: DataFrame) -> dict[str, tuple[float, dict[str, list[float]]]]:
    """A classifier for each kind that has candidates, from counts of feature patterns over all documents."""
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", *(f"c.{f}" for f in FEATURES))
    counted: dict[str, list] = {}
    for row in each.groupBy("kind", *FEATURES).count().collect():
        counted.setdefault(row["kind"], []).append((tuple(row[f] for f in FEATURES), row["count"]))
    models = {}
    for kind, rows in sorted(counted.items()):
        votes: dict[tuple[int, ...], int] = {}
        for x, c in rows:
            votes[x[: len(LABELERS)]] = votes.get(x[: len(LABELERS)], 0) + c
        post = label_model(dict(sorted(votes.items())))
        models[kind] = train_classifier([(x, c, post[x[: len(LABELERS)]]) for x, c in sorted(rows)])
    return models


def probability(c: Column, models: dict) -> Column:
    out = F.lit(0.0)
    for kind, (bias, weights) in models.items():
        z = F.lit(bias)
        for f in FEATURES:
            z = z + F.element_at(F.array(*(F.lit(w) for w in weights[f])), c[f] + 1)
        out = F.when(c["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def find_pii(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with two columns, replaced if there: ``base`` and ``spans``, arrays of struct(start, rank, end, kind).

    ``spans`` are the base spans and the candidates that overlap none of them and that the classifier gives ``least`` or
    more; of overlapping ones the first, then the one of the first kind, then the shortest stays.  Null and empty texts
    have no spans.  Rows are judged one by one, with one model for all, so repeated rows get equal spans; an empty table
    gives an empty result.
    """
    names = [n for n in docs.columns if n.lower() not in ("base", "spans")]
    own = shared.fresh("candidates", names)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = shared.materialise(docs.select(*(F.col(f"`{n}`") for n in names), candidates(text).alias(own)), "pii")
    models = fit(found.select(F.col(own).alias("candidates")))
    slim = lambda xs: F.transform(xs, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    base = F.filter(own, lambda c: c["base"])

    def chosen(b: Column) -> Column:
        free = lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))
        more = slim(F.filter(own, lambda c: ~c["base"] & (probability(c, models) >= least) & free(c)))
        none = F.struct(F.lit(0).cast("long").alias("at"), F.slice(more, 1, 0).alias("out"))
        apart = lambda xs: F.aggregate(xs, none, lambda acc, c: F.when(c["start"] >= acc["at"], F.struct(c["end"].alias("at"), F.concat(acc["out"], F.array(c)).alias("out"))).otherwise(acc))["out"]
        return F.sort_array(F.concat(slim(b), let(more, lambda xs: F.when(F.size(xs) > 1, apart(xs)).otherwise(xs))))

    return found.select(*(F.col(f"`{n}`") for n in names), slim(base).alias("base"), let(base, chosen).alias("spans"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [n(k) for k in KINDS[:4]]
    return find_pii(docs).select("doc_id", *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
