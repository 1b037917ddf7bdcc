"""Personal data: base patterns, and information-theoretic sanitisation of what gives them away.

Base spans are emails, IPv4 addresses, payment cards and phone numbers, each
kind read leftmost without overlaps; matches that fail their test are dropped.
Values given to a name like token, secret or password are spans of kind
``secret``. Protected entities are what each of these spans says, and the kinds
themselves: that a document holds an address or a secret at all.

Corpus co-occurrence tells how strongly a term reveals an entity: with N
documents, n(c) that hold the entity, n(t) the term and n(c,t) both, wherever
they stand in them,

    disclosure = log2(p N / n(c)) / log2(N / n(c)),  p = (n(c,t) + n(c) / N) / (n(t) + 1),

the share of the entity's information that the term gives, with its chance p of
the entity smoothed by one row of the corpus. Terms are words, strings of
letters and digits, and the shapes of such strings from ``SHAPED`` characters
(40 hexadecimal digits are one term, whichever they are).

A share alone is no evidence: a rare word that stands once beside a rare address
gives it away by that count. So a pair makes a rule only if as many different
documents (equal texts are one) would hold both, without any tie, with a chance
of at most ``CHANCE`` divided by all pairs that could have made one: all terms
for a kind, all values times all terms for a value. Entities of a single
document therefore have no rules, and neither have words that met an entity so
seldom that chance explains it; the chance that the whole corpus has one false
rule of values, or of a kind, is ``CHANCE`` at most.

Terms at ``REMOVE`` or more are removed and those at ``GENERALISE`` or more are
generalised to a class; both are spans of kind ``term``. The terms of a value
are marked in the documents that hold it, those of a kind in all documents: a
string of a secret's shape is marked where no name stands before it. All counts
cover all documents, each document once. Pairs whose counts can reach neither the
share nor the evidence are not even made, so that a page of many addresses and
words does not yield their product: the ``PART`` most frequent terms and
entities are known to the workers for that, and the pairs of kinds are counted with the
terms, so that different texts are counted only for those that can make a rule
(all, if these are more than ``PART``). Up to ``PART`` rules are broadcast; more
rules of values are joined to the entities of each text, and the terms to the
texts that a bitmap asks for, and more rules of kinds are broadcast in parts.
Either way a term that is to be removed for one entity and generalised for
another is removed, once.

Defined cases: null text is empty and has no spans; offsets are code points,
ends exclusive; terms inside other spans are not marked again; a base span has
precedence over a secret that starts inside it; other columns stay, and the new
one's name gets underscores until it is free.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter
from math import lgamma, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexeum.llm import common as C

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term")
#: Letters and digits in a row from which on a string's shape is a term too; longer strings than ``WHOLE`` are known by a hash.
SHAPED, WHOLE = 12, 48
CHANCE, GENERALISE, REMOVE, PART = 0.01, 0.6, 0.85, 200_000
FLUSH = 400_000
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A number starts where its digits do and a dot is no digit, so nothing is lost by never giving back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]{3,}")
_LONG = re.compile(rf"[^\W_]{{{SHAPED},}}")
#: Names whose value is a secret.
SECRETS = ("token", "secret", "password", "passwd", "passwort", "pwd", "passphrase", "apikey", "api_key", "api-key", "access_key", "private_key", "auth_key", "clave", "contraseña", "mot de passe")
_ASSIGNED = re.compile("[=:]")
_VALUE = re.compile(r"""[=:]?[ \t]{0,4}(["']?)([^\s"'<>,;]{8,})""")
_SEPARATORS = {ord(c): None for c in " -"}
FOUND = "struct<kinds:array<string>,starts:array<bigint>,ends:array<bigint>,actions:array<string>>"
_KIND = pa.struct([("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("actions", pa.list_(pa.string()))])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base matches, by start and then kind as listed."""
    out = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            at = m.start()
            k = at
            while k > done and (text[k - 1].isascii() and text[k - 1].isalnum() or text[k - 1] in "._%+-"):
                k -= 1
            if k < at:
                done = m.end()
                out.append((k, done, "email"))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m[0].translate(_SEPARATORS)
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def _digest(said: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(said.encode("utf-8", "surrogatepass")) - (1 << 63)


def secret_spans(text: str, base) -> list[tuple[int, int, str]]:
    """Values given to a secret's name, in quotes or with a digit, but for those a base span meets."""
    out, done, cover = [], 0, None
    for m in _ASSIGNED.finditer(text):
        if m.start() < done:
            continue
        head = text[max(0, m.start() - 24) : m.start()].rstrip(" \t")
        if not (head[:-1] if head[-1:] in ("'", '"') else head).lower().endswith(SECRETS):
            continue
        v = _VALUE.match(text, m.end())
        if v and (v[1] or any(map(str.isdigit, v[2]))):
            cover = cover or _cover(base)
            done = v.end()
            if not (base and _covered(cover, *v.span(2))):
                out.append((*v.span(2), "secret"))
    return out


def known_spans(text: str) -> list[tuple[int, int, str]]:
    """Base spans and secrets, by start and then kind as listed."""
    base = base_spans(text)
    more = secret_spans(text, base)
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def entity(text: str, span: tuple[int, int, str]) -> int:
    """A signed 64-bit name of what the span says."""
    a, b, kind = span
    said = text[a:b] if kind == "secret" else text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
    return _digest(f"{kind}:{said}")


def kind_entity(kind: str) -> int:
    """The name of a kind: its place among the kinds, which no value has but by a chance of 2**-61."""
    return KINDS.index(kind)


def entities(text: str, spans) -> set[int]:
    """What a document's spans say, and their kinds."""
    return {entity(text, s) for s in spans} | {kind_entity(k) for _, _, k in spans}


def _cover(spans) -> tuple[list[int], list[int]]:
    """Starts of the spans, and the furthest end up to each."""
    return [s[0] for s in spans], list(itertools.accumulate((s[1] for s in spans), max))


def _covered(cover, a: int, b: int) -> bool:
    i = bisect.bisect_left(cover[0], b)
    return i > 0 and cover[1][i - 1] > a


def names(word: str) -> tuple[str, ...]:
    """The terms that a string of letters and digits is: itself in small letters (a hash if it is very long), and its shape if it has digits."""
    low = word.lower()
    own = low if len(low) <= WHOLE else f"#{_digest(low):x}"
    if word.isalpha():
        return (own,)
    if len(word) < SHAPED:
        return () if word.isdigit() else (own,)
    kind = "digit" if word.isdigit() else "hex" if all(c in "0123456789abcdef" for c in low) else "mixed"
    size = len(word) if len(word) <= 64 else 1 << (len(word) - 1).bit_length()
    return (own, f"<{kind} {size}>")


def _named(words: set[str]) -> set[str]:
    """The terms that any of the strings is."""
    odd = [w for w in words if len(w) > WHOLE or not w.isalpha()]
    out = set(map(str.lower, words.difference(odd)))
    for w in odd:
        out.update(names(w))
    return out


def terms(text: str, spans) -> set[str]:
    """The terms of a document outside its base spans. A secret's value is a term too, so that its shape is learned."""
    spans = [s for s in spans if s[2] != "secret"]
    if not spans:
        return _named(set(_WORD.findall(text)))
    cover = _cover(spans)
    return _named({m[0] for m in _WORD.finditer(text) if not _covered(cover, m.start(), m.end())})


def _tally(batches):
    """Documents by entity (c, null, n), by term (null, t, n), and by kind and term (c, t, n)."""
    held: Counter = Counter()
    seen: Counter = Counter()
    both = {kind_entity(k): Counter() for k in KINDS[:-1]}

    def out():
        c, t, n = [*held, *[None] * len(seen)], [*[None] * len(held), *seen], [*held.values(), *seen.values()]
        for k, own in both.items():
            c += [k] * len(own)
            t += own
            n += own.values()
        for x in (held, seen, *both.values()):
            x.clear()
        return pa.record_batch([pa.array(c, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64())], ["c", "t", "n"])

    for batch in batches:
        for x in batch.column(0).to_pylist():
            if x:
                spans = known_spans(x)
                have = terms(x, spans)
                seen.update(have)
                if spans:
                    held.update(entities(x, spans))
                    for k in {k for _, _, k in spans}:
                        both[kind_entity(k)].update(have)
                if len(held) + len(seen) + sum(map(len, both.values())) > FLUSH:
                    yield out()
    yield out()


def _met(batches, limits: dict[int, tuple[int, int]], other: tuple[int, int], known: dict[str, int], rare: int, likely: dict[int, set[str]] | None):
    """(entity, term, text) of each document, but for pairs whose counts cannot make a rule, and terms not likely for a kind.

    Terms that are not known stand in at most ``rare`` documents; 0 says that none of them can make a rule of a value.
    """
    rows: list[tuple[int, str, int]] = []

    def out():
        c, t, h = zip(*rows, strict=True)
        return pa.record_batch([pa.array(c, pa.int64()), pa.array(t, pa.string()), pa.array(h, pa.int64())], ["c", "t", "h"])

    for batch in batches:
        for x in batch.column(0).to_pylist():
            if not x or not (spans := known_spans(x)):
                continue
            wanted = []
            for c in entities(x, spans):
                if likely is not None and 0 <= c < len(KINDS):
                    wanted += [(c, None)] if c in likely else []
                elif (span := limits.get(c, other) if c >= len(KINDS) or c < 0 else (0, 1 << 62))[1]:
                    wanted.append((c, span))
            if not wanted:
                continue
            h = _digest(x)
            have = [(t, known.get(t)) for t in terms(x, spans)]
            for c, span in wanted:
                if span is None:
                    rows += [(c, t, h) for t, _ in have if t in likely[c]]
                else:
                    least, most = span
                    rows += [(c, t, h) for t, n in have if (least <= n <= most if n is not None else least <= rare)]
                if len(rows) > FLUSH:
                    yield out()
                    rows.clear()
    if rows:
        yield out()


def _share(n: Column, nc: Column, nt: Column, total: int) -> Column:
    """The disclosure; null where the entity stands in all documents."""
    p = (n + nc / F.lit(float(total))) / (nt + 1)
    ic = F.log2(F.lit(float(total)) / nc)
    return F.try_divide(F.log2(p) + ic, ic)


def _log_chance(x: Column, n: Column, nc: Column, nt: Column, total: int) -> Column:
    """A bound on the log of the chance that ``x`` different contexts hold both without a tie (Poisson; copies taken out of all counts alike)."""
    mean = nc * nt * (x / n) * (x / n) / F.lit(float(total))
    few = x * F.log(mean) - F.log(F.factorial(F.least(x, F.lit(20)).cast("int")))
    many = F.when(x > mean, x - mean - x * F.log(x / mean)).otherwise(0.0)
    return F.least(F.when(x <= 20, few), many)


def log_chance(x: int, n: int, nc: int, nt: int, total: int) -> float:
    """:func:`_log_chance` of plain numbers."""
    mean = nc * nt * (x / n) ** 2 / total
    many = x - mean - x * log(x / mean) if x > mean else 0.0
    return min(many, x * log(mean) - lgamma(x + 1)) if x <= 20 else many


def reach(nc: int, total: int, enough: float, generalise: float) -> tuple[int, int]:
    """The least and the most documents a term may have for a rule with an entity of ``nc``; (1, 0) if there is none.

    The most follows from the disclosure too, both from the case in which all
    documents that can hold both do, as different texts or as copies.
    """

    def can(nt: int) -> bool:
        n = min(nc, nt)
        return any(log_chance(x, n, nc, nt, total) <= enough for x in {n, *range(1, min(n, 20) + 1)})

    least = next((nt for nt in range(1, min(nc, 64) + 1) if can(nt)), nc if can(nc) else 0)
    if not least:
        return 1, 0
    low, high = max(least, nc if can(nc) else least), int((nc + 1) * (total / nc) ** (1 - generalise)) + 1
    while low < high:  # more documents of the term only add to what chance explains
        mid = (low + high + 1) // 2
        low, high = (mid, high) if can(mid) else (low, mid - 1)
    return least, low


def _cut(rows: DataFrame, n: str, part: int) -> int:
    """The least count such that no more than ``part`` rows have a greater one; from a row for each count that occurs."""
    seen = 0
    for r in sorted(rows.groupBy(n).count().collect(), reverse=True):
        seen += r["count"]
        if seen > part:
            return r[n]
    return 0


def learn(docs: DataFrame, text: str = "text", chance: float = CHANCE, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(c, t, disclosure, action): which terms give which entities away. Stored in the shared folder."""
    spark = C.ready(docs.sparkSession)
    texts = docs.select(text)
    seen = C.stored(texts.mapInArrow(_tally, "c bigint, t string, n bigint").groupBy("c", "t").agg(F.sum("n").alias("n")), "seen")
    own = seen.filter("t IS NULL").select("c", F.col("n").alias("nc"))
    freq = seen.filter("c IS NULL").select("t", F.col("n").alias("nt"))
    total, n_terms = max(1, docs.count()), max(1, freq.count())
    of_kind = F.col("c").between(0, len(KINDS) - 1)
    # a kind is tried with all terms, and each value with all terms: so many chances share the one that is allowed
    enough_kind, enough = log(chance / n_terms), log(chance / n_terms / max(1, own.filter(~of_kind).count()))

    # entities of documents enough for any rule, and terms that some of these can have; of more than PART the most frequent
    fewest = next((k for k in range(1, 65) if reach(k, total, enough, generalise)[1]), 65)
    values = own.filter(~of_kind & (F.col("nc") >= fewest))
    above = _cut(values, "nc", PART)
    often = values.filter(F.col("nc") > above).toArrow().to_pydict()
    spans = {k: reach(k, total, enough, generalise) for k in set(often["nc"])}
    limits = {c: spans[k] for c, k in zip(often["c"], often["nc"], strict=True)}
    other = (1, reach(above, total, 0.0, generalise)[1]) if above >= fewest else (1, 0)
    can = [s for s in (*spans.values(), other) if s[1]]
    able = freq.filter(F.col("nt").between(min((s[0] for s in can), default=1), max((s[1] for s in can), default=0)))
    rare = _cut(able, "nt", PART)
    some = freq.filter(F.col("nt") > rare) if rare else able
    some = some.limit(0) if rare and some.count() > 2 * PART else some
    known = dict(zip(*some.select("t", "nt").toArrow().to_pydict().values(), strict=True))
    n, nc, nt = F.col("n"), F.col("nc"), F.col("nt")
    # the counts of a kind's pairs are known; only those that can make a rule are looked at again, for their different texts
    pairs_ = seen.filter("c IS NOT NULL AND t IS NOT NULL").join(F.broadcast(own.filter(of_kind)), "c").join(freq, "t")
    pairs_ = pairs_.filter((_share(n, nc, nt, total) >= generalise) & (_log_chance(n, n, nc, nt, total) <= enough_kind)).select("c", "t").limit(PART + 1).collect()
    likely: dict[int, set[str]] | None = {}
    for r in pairs_:
        likely.setdefault(r.c, set()).add(r.t)
    likely = likely if len(pairs_) <= PART else None
    sent = spark.sparkContext.broadcast((limits, other, known, rare, likely))

    def pairs(batches):
        yield from _met(batches, *sent.value)

    met = texts.mapInArrow(pairs, "c bigint, t string, h bigint").groupBy("c", "t", "h").agg(F.count("*").alias("n"))
    near = met.groupBy("c", "t").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))
    rules = near.join(freq, "t").join(own, "c").withColumn("disclosure", _share(n, nc, nt, total)).filter(F.col("disclosure") >= generalise)
    rules = rules.filter(_log_chance(F.col("contexts"), n, nc, nt, total) <= F.when(of_kind, enough_kind).otherwise(enough))
    out = C.stored(rules.select("c", "t", "disclosure", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action")), "rules")
    C.forget(seen)
    return out


def _stronger(out: dict[str, str], more: dict[str, str]) -> None:
    """Add actions to ``out``, 'remove' before 'generalise'."""
    for t, action in more.items():
        if out.get(t) != "remove":
            out[t] = action


def _terms_of(text: str, spans, rules: dict[int, dict[str, str]], everywhere: dict[str, str]) -> dict[str, str]:
    """The terms that give any entity of the document away, and those of kinds."""
    mine = [rules[c] for c in {entity(text, s) for s in spans} if c in rules] if rules else []
    if not mine:
        return everywhere
    out = dict(everywhere)  # a plain one
    for r in mine:
        _stronger(out, r)
    return out


class Everywhere(dict):
    """Actions of the terms of kinds, with a quick look whether a text can hold any."""

    def may_be_in(self, text: str) -> bool:
        if "_look" not in self.__dict__:
            shapes = any(t.startswith(("<", "#")) for t in self)
            self._look = ([t for t in self if not t.startswith(("<", "#"))], shapes) if len(self) <= 64 else None
        if self._look is None or "\u03a3" in text:  # a large sigma's small form depends on what follows
            return True
        words, shapes = self._look
        low = text.lower()
        return any(t in low for t in words) or shapes and _LONG.search(text) is not None


def all_spans(text: str, known, terms: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """The known spans and those of terms that give entities away."""
    out = [(*s, "remove") for s in known]
    if isinstance(terms, Everywhere) and not terms.may_be_in(text):
        return out
    if terms and any(t in terms for t in _named(set(_WORD.findall(text)))):
        cover = _cover(known)
        for m in _WORD.finditer(text):
            action = max((terms[t] for t in names(m[0]) if t in terms), default=None)  # 'remove' is the greater
            if action and not _covered(cover, m.start(), m.end()):
                out.append((m.start(), m.end(), "term", action))
        out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def _found(rows) -> pa.Array:
    cols = [[[s[j] for s in r] for r in rows] for j in (2, 0, 1, 3)]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _KIND, strict=True)], fields=list(_KIND))


def _finder(rules, everywhere):
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts.to_pylist():
            known = known_spans(x) if x else []
            rows.append(all_spans(x, known, _terms_of(x, known, rules.value, everywhere.value)) if x else [])
        return _found(rows)

    return find


def _find_given(everywhere):
    def find(texts: pa.Array, remove: pa.Array, generalise: pa.Array) -> pa.Array:
        rows = []
        for x, r, g in zip(texts.to_pylist(), remove.to_pylist(), generalise.to_pylist(), strict=True):
            terms = everywhere.value
            if r or g:
                terms = dict(terms)
                _stronger(terms, dict.fromkeys(g or (), "generalise") | dict.fromkeys(r or (), "remove"))
            rows.append(all_spans(x, known_spans(x), terms) if x else [])
        return _found(rows)

    return find


def _entities(texts: pa.Array) -> pa.Array:
    return pa.array([sorted({entity(x, s) for s in known_spans(x)}) if x else [] for x in texts.to_pylist()], pa.list_(pa.int64()))


def _marked_words(marks):
    """Of each text: its terms among ``marks``, as two lists."""

    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts.to_pylist():
            have = [t for t in _named(set(_WORD.findall(x or ""))) if t in marks.value]
            rows.append({k: sorted(t for t in have if marks.value[t] == k) for k in ("remove", "generalise")})
        return pa.array(rows, pa.struct([("remove", pa.list_(pa.string())), ("generalise", pa.list_(pa.string()))]))

    return find


def with_spans(docs: DataFrame, rules: DataFrame, text: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with a struct of arrays: kinds, starts, ends, actions, in order."""
    sc, name = C.ready(docs.sparkSession).sparkContext, C.fresh(docs, name)
    of_kinds = F.col("c").between(0, len(KINDS) - 1)
    everywhere = rules.filter(of_kinds).groupBy("t").agg(F.max("action").alias("action"))  # 'remove' is the greater
    rules = rules.filter(~of_kinds)
    n, n_kinds = rules.count(), everywhere.count()
    table: dict[int, dict[str, str]] = {}
    if n <= PART and n_kinds <= PART:
        for r in rules.collect():
            table.setdefault(r.c, {})[r.t] = r.action
        find = _finder(sc.broadcast(table), sc.broadcast(Everywhere((r.t, r.action) for r in everywhere.collect())))
        return docs.withColumn(name, F.arrow_udf(find, FOUND).asNondeterministic()(F.col(text)))
    key, gone, less = (C.fresh(docs, x) for x in ("_text_key", "_remove", "_generalise"))
    own = docs.select(F.md5(text).alias(key), F.explode(F.arrow_udf(_entities, "array<bigint>").asNondeterministic()(F.col(text))).alias("c")).distinct()
    each = own.join(rules.select("c", "t", "action"), "c").groupBy(key, "t").agg(F.max("action").alias("action"))
    kept = lambda action: F.collect_list(F.when(F.col("action") == action, F.col("t")))
    marks = C.stored(each.groupBy(key).agg(kept("remove").alias(gone), kept("generalise").alias(less)), "marks")
    some, rest = C.split_by(docs.withColumn(key, F.md5(text)), key, C.bitmap(marks, key))
    none = F.lit(None).cast("array<string>")
    both = some.join(marks, key, "left").select(*C.columns(docs), gone, less).unionByName(rest.select(*C.columns(docs), none.alias(gone), none.alias(less)))
    parts = -(-n_kinds // PART)
    found = []
    for p in range(parts if parts > 1 else 0):  # the terms of kinds that each text has, in parts of a bounded size
        part = everywhere.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == p)
        f = F.arrow_udf(_marked_words(sc.broadcast({r.t: r.action for r in part.collect()})), "struct<remove:array<string>,generalise:array<string>>").asNondeterministic()(F.col(text))
        found.append(C.fresh(both, f"_marks_{p}"))
        both = both.withColumn(found[-1], f)
    every = lambda own, field: F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in (F.col(own), *(F.col(f"{x}.{field}") for x in found)))))
    find = _find_given(sc.broadcast(Everywhere((r.t, r.action) for r in everywhere.collect()) if parts <= 1 else Everywhere()))
    return both.withColumn(name, F.arrow_udf(find, FOUND).asNondeterministic()(F.col(text), every(gone, "remove"), every(less, "generalise"))).drop(gone, less, *found)


def joined(kinds, starts, ends) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in zip(kinds, starts, ends, strict=True))


def digest(found: pa.Array) -> pa.Array:
    """The hash of the base spans and the text of all spans, of each struct of ``with_spans``."""
    sha, said = [], []
    for r in found.to_pylist():
        rows = list(zip(r["kinds"], r["starts"], r["ends"], strict=True))
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in rows if k in BASE)
        sha.append(hashlib.sha256(base.encode()).hexdigest())
        said.append(joined(r["kinds"], r["starts"], r["ends"]))
    return pa.StructArray.from_arrays([pa.array(sha, pa.string()), pa.array(said, pa.string())], ["base_sha256", "spans"])


def sanitised(text: pa.Array, found: pa.Array) -> pa.Array:
    """Texts with base spans and removed terms replaced by their kind, generalised terms by a class."""
    out = []
    for t, r in zip(text.to_pylist(), found.to_pylist(), strict=True):
        if t is None:
            out.append(None)
            continue
        parts, at = [], 0
        for k, a, b, act in zip(r["kinds"], r["starts"], r["ends"], r["actions"], strict=True):
            if b <= at:
                continue
            shown = f"[{k.upper()}]" if k != "term" else "[REMOVED]" if act == "remove" else "[NAME]" if t[a : a + 1].isupper() else "[WORD]"
            parts += [t[at : max(a, at)], shown]
            at = b
        out.append("".join([*parts, t[at:]]))
    return pa.array(out, pa.string())


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text sanitised; columns stay as they are."""
    name = C.fresh(docs, "found")
    marked = with_spans(docs, learn(docs, text), text, name)
    return marked.withColumn(text, F.arrow_udf(sanitised, "string").asNondeterministic()(F.col(text), F.col(name))).drop(name)
