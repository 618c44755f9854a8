"""Personal data by pattern, and terms that give it away by co-occurrence.

Patterns. Four kinds are found with fixed regular expressions and checked (address parts,
Luhn, digit counts). Java's matcher recurses on repeated groups and rescans long runs, so
the expressions used here are rewritten to match the same spans in linear time.

Entities. A value is an entity, and so is its class: an address' domain, the first three
parts of an ip, a card's issuer (six digits), a phone's country and area (four digits).

Disclosure. After C-sanitisation (Sanchez and Batet, 2016): a term t reveals an entity e by
their pointwise mutual information, PMI(t; e) = log2 p(t, e) / (p(t) p(e)), which is at most
the entity's information content IC(e) = -log2 p(e). The p are shares of all documents, and
a document holds t and e wherever they stand in it. What a reader of t still lacks is
IC - PMI = -log2 p(e | t) bits. Terms that leave at most -log2 ``REMOVE`` bits are removed,
those that leave at most -log2 ``GENERALISE`` bits are replaced by the term with which they
are found most often among those that are more frequent and tell nothing. (A threshold on
the share PMI / IC alone would let a term tell a frequent entity that nine of ten of its
documents don't hold.) Of a word that goes with addresses as such nobody learns whose
address it is: among the documents with e's kind of value, PMI must be ``OF_KIND`` of IC.

Evidence. A share counts if chance does not explain it: by Chernoff's bound, d texts with e
of which a share q hold t have d * KL(q || p(t)) bits of evidence. log2 of the documents
plus ``EVIDENCE`` bits are asked for. One text can't have that many, so entities and pairs
found in one text only are left out, as are terms too frequent for the entity. Exact
copies count in the p, not in the evidence.

Everything is DataFrame operations. The patterns run once over the texts; the words of all
texts are counted in a second pass, for the terms that may tell by what the documents with
values say, and a third pass places those that do. Both are left out where there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import checkpoint

EVIDENCE = 10.0
GENERALISE = 0.9
REMOVE = 0.99
OF_KIND = 0.6
#: Terms to look for are broadcast up to so many, beyond that joined by a shuffle.
BROADCAST_TERMS = 100_000

KINDS = ("email", "ip", "card", "phone")
#: What stands in for each kind in sanitised text; a term's class stands in brackets.
REPLACEMENTS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term_removed": ""}

_SPAN = "array<struct<start int, rank int, stop int, kind string, value string>>"

_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9 -]*[0-9]"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_TERM = r"[\p{L}\p{N}]++"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _sql(text: str) -> str:
    return "r'" + text + "'"


#: Matches whose lengths are summed at once, so that positions cost a little more than the text's length.
_STEP = 64
#: Code points of a block of text from which pieces are cut.
_BLOCK = 1024


def _bound(value: str, name: str, body: str) -> str:
    """SQL for body with value computed once under a name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _found(text: str, regex: str, kind: str, rank: int, keep: str) -> str:
    """SQL for the spans of regex in the text expression; keep is a condition on x.value, the matched string.

    Positions are sums of the lengths of the pieces between the matches and of the matches:
    whole steps of them are summed first, then the few before each match in its step.
    """
    regex = _sql(regex)
    step = f"aggregate(sequence(0, size(s.n) div {_STEP}), array(0), (a, i) -> array_append(a, element_at(a, -1) + aggregate(slice(s.n, i * {_STEP} + 1, {_STEP}), 0, (y, z) -> y + z)))"
    start = f"v.b[i div {_STEP}] + aggregate(slice(v.n, i div {_STEP} * {_STEP} + 1, i % {_STEP}), 0, (y, z) -> y + z) + length(v.p[i])"
    span = f"named_struct('start', o, 'rank', {rank}, 'stop', o + length(m), 'kind', '{kind}', 'value', m)"
    spans = f"filter(transform(v.m, (m, i) -> {_bound(start, 'o', span)}), x -> {keep})"
    with_steps = _bound(f"named_struct('p', s.p, 'm', s.m, 'n', s.n, 'b', {step})", "v", spans)
    with_sizes = _bound("named_struct('p', r.p, 'm', r.m, 'n', zip_with(r.p, r.m, (p, m) -> length(p) + coalesce(length(m), 0)))", "s", with_steps)
    return _bound(f"named_struct('p', split({text}, {regex}, -1), 'm', regexp_extract_all({text}, {regex}, 0))", "r", with_sizes)


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + case
    when (length({_DIGITS}) - i) % 2 = 0 then cast(substring({_DIGITS}, i, 1) as int)
    when substring({_DIGITS}, i, 1) > '4' then 2 * cast(substring({_DIGITS}, i, 1) as int) - 9
    else 2 * cast(substring({_DIGITS}, i, 1) as int) end) % 10 = 0"""


def base_spans(text: str) -> Column:
    """The four kinds' spans in the column named text, ordered by start, then kind. Null text has none.

    Each kind is gated by a cheap test, so most texts only pay for the tests. A card is a
    run of digits with single separators: separators that have a neighbour are first
    replaced, character for character, so that a run is a plain character class.
    """
    t = f"`{text}`"
    single = f"regexp_replace({t}, '[ -](?=[ -])|(?<=[ -])[ -]', '#')"
    none = f"cast(array() as {_SPAN})"
    ip_ok = f"x.value rlike {_sql('^' + _BYTE + '(?:[.]' + _BYTE + '){3}$')}"
    card_ok = f"length({_DIGITS}) between 14 and 19 and {_LUHN}"
    phone_ok = f"length({_DIGITS}) between 10 and 15"
    found = [
        f"case when contains({t}, '@') then {_found(t, _EMAIL, 'email', 0, 'true')} else {none} end",
        f"case when {t} rlike {_sql(_IP)} then {_found(t, _IP, 'ip', 1, ip_ok)} else {none} end",
        f"case when {t} rlike '[0-9](?:[ -]?[0-9]){{13}}' then {_found(single, _CARD, 'card', 2, card_ok)} else {none} end",
        f"case when {t} rlike '[+][0-9]' then {_found(t, _PHONE, 'phone', 3, phone_ok)} else {none} end",
    ]
    return F.expr(f"sort_array(concat({', '.join(found)}))")


def terms_of(text: str) -> Column:
    """The different words with a letter of the column named text, in lower case, those of addresses left out."""
    t = f"`{text}`"
    open_text = f"case when contains({t}, '@') then regexp_replace({t}, {_sql(_EMAIL)}, ' ') else {t} end"
    return F.expr(f"array_distinct(transform(filter(split({open_text}, {_sql('[^\\p{L}\\p{N}]+')}), w -> w rlike {_sql('\\p{L}')}), w -> lower(w)))")


def _entities() -> Column:
    """The values of base and their classes, each once; the part before the first : or @ is the kind."""
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    named = f"""case s.kind when 'email' then substring_index(lower(s.value), '@', -1) when 'ip' then regexp_replace(s.value, '[.][0-9]+$', '')
        when 'card' then substring({digits}, 1, 6) else substring({digits}, 1, 4) end"""
    return F.expr(f"array_distinct(flatten(transform(base, s -> array(concat(s.kind, ':', lower(s.value)), concat(s.kind, '@', {named})))))")


def _text_hash(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def _base(text_col: str) -> Column:
    return F.coalesce(base_spans(text_col), F.expr(f"cast(array() as {_SPAN})"))


def _beside(small: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(small) if small.count() <= limit else small


def told_terms(held: DataFrame, texts: DataFrame, total: int, evidence: float, generalise: float, remove: float, broadcast_terms: int) -> DataFrame | None:
    """(term, kind, class): the terms that tell, of the documents (text_hash, base, terms) with values; None if none can.

    texts (text) are all documents, ``total`` of them; their words are counted only for terms
    that would tell if no document without values held them, which the held documents show,
    so nothing is lost. A held document has as many pairs of a term and an entity as its own
    words and values make, after terms too frequent for the entity are left out.
    """
    held = held.withColumn("entities", _entities()).groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.any_value("terms").alias("terms"), F.any_value("entities").alias("entities"))
    held = checkpoint(held.withColumn("kinds", F.expr("array_distinct(transform(entities, e -> regexp_extract(e, '^([a-z]+)', 1)))")))
    per_kind = held.select("copies", F.explode("kinds").alias("of")).groupBy("of").agg(F.sum("copies").alias("n_k"))
    entities = held.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("d_e")).where("d_e >= 2")
    entities = checkpoint(entities.withColumn("of", F.regexp_extract("entity", "^([a-z]+)", 1)).join(F.broadcast(per_kind), "of").where("n_e < n_k"))
    if entities.isEmpty():
        return None
    named = held.select("text_hash", F.explode("entities").alias("entity")).join(entities, "entity")
    named = named.groupBy("text_hash").agg(F.collect_list(F.struct("entity", "of", "n_e", "d_e", "n_k")).alias("named"))
    known = checkpoint(held.join(named, "text_hash").select("copies", "terms", "named"))
    heard = held.select("copies", "kinds", F.explode("terms").alias("term")).groupBy("term")
    heard = heard.agg(F.count(F.lit(1)).alias("d_t"), F.sum("copies").alias("n_h"), *(F.sum(F.when(F.array_contains("kinds", k), F.col("copies")).otherwise(0)).alias(f"n_{k}") for k in KINDS)).where("d_t >= 2")
    heard = checkpoint(heard.drop("d_t"))
    of_kind = lambda e: F.coalesce(*(F.when(e["of"] == k, F.col(f"n_{k}")) for k in KINDS))
    words = known.select("copies", F.explode("terms").alias("term"), "named").join(_beside(heard, broadcast_terms), "term")
    rare = F.filter("named", lambda e: of_kind(e) * generalise <= e["n_e"])
    pairs = words.select("copies", "term", F.explode(F.transform(rare, lambda e: F.struct(*(e[c].alias(c) for c in ("entity", "of", "n_e", "d_e", "n_k")), of_kind(e).alias("n_tk")))).alias("e")).select("copies", "term", "e.*")
    joint = pairs.groupBy("term", "entity", "of", "n_e", "d_e", "n_k", "n_tk").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("d_te")).where("d_te >= 2")
    n, q = F.lit(float(total)), F.col("d_te") / F.col("d_e")
    among = F.log2(F.col("n_te") * F.col("n_k") / (F.col("n_tk") * F.col("n_e"))) / F.log2(F.col("n_k") / F.col("n_e"))

    def proven(n_t: str) -> Column:
        p = F.col(n_t) / n
        bits = F.col("d_e") * (q * F.log2(q / p) + F.when(q < 1, (1 - q) * F.log2((1 - q) / (1 - p))).otherwise(0.0))
        return (q > p) & (bits >= F.log2(n) + evidence)

    joint = checkpoint(joint.withColumn("among", among).where((F.col("among") >= OF_KIND) & (F.col("n_te") >= generalise * F.col("n_tk")) & proven("n_tk")))
    if joint.isEmpty():
        return None
    beside = _beside(checkpoint(joint.select("term").distinct()), broadcast_terms)
    counts = texts.select(F.explode(terms_of("text")).alias("term")).join(beside, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    certain = F.col("n_te") / F.col("n_t")
    shares = joint.join(counts, "term").withColumn("certain", certain).where((F.col("certain") >= generalise) & proven("n_t"))
    told = checkpoint(shares.groupBy("term").agg(F.max("certain").alias("certain")))
    # the class: what the term is found with most often beside values, of the more frequent terms there that tell nothing; the rarest of these, then the first by name
    vague = _beside(told.where(F.col("certain") < remove).select("term").join(heard.select("term", "n_h"), "term"), broadcast_terms)
    beside_it = held.select("text_hash", F.explode("terms").alias("term")).join(vague, "term").join(held.select("text_hash", "copies", "terms"), "text_hash").select("copies", "term", "n_h", F.explode("terms").alias("other"))
    others = heard.select(F.col("term").alias("other"), F.col("n_h").alias("n_o")).join(told.select(F.col("term").alias("other")), "other", "left_anti")
    classes = beside_it.join(others, "other").where("n_o > n_h").groupBy("term", "other", "n_o").agg(F.sum("copies").alias("n"))
    classes = classes.groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("minus"), "n_o", "other")).alias("m")).select("term", F.col("m.other").alias("class"))
    kind = F.when(F.col("certain") >= remove, F.lit("term_removed")).otherwise(F.lit("term"))
    return checkpoint(told.join(classes, "term", "left").select("term", kind.alias("kind"), F.concat(F.lit("["), F.coalesce("class", F.lit("TERM")), F.lit("]")).alias("class")))


def term_spans(texts: DataFrame, told: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(text_hash, extra): the spans of the terms that tell, in each of texts (text_hash, text) that holds any, outside every pattern's span.

    A span's value is what stands in for it.
    """
    beside = _beside(told, broadcast_terms)
    hits = texts.select("text_hash", F.explode(terms_of("text")).alias("term")).join(beside, "term").select("text_hash", "term", "kind", "class").distinct()
    hits = checkpoint(hits.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("kind", "class")))).alias("told")))
    held = texts.join(_beside(hits, broadcast_terms), "text_hash").withColumn("base", _base("text"))
    placed = f"""transform(
        filter({_found('text', _TERM, 'term', 4, 'map_contains_key(told, lower(x.value))')}, w -> not exists(base, s -> s.start < w.stop and w.start < s.stop)),
        w -> named_struct('start', w.start, 'rank', if(told[lower(w.value)].kind = 'term', 4, 5), 'stop', w.stop, 'kind', told[lower(w.value)].kind, 'value', told[lower(w.value)].class))"""
    return checkpoint(held.select("text_hash", F.expr(placed).cast(_SPAN).alias("extra")).groupBy("text_hash").agg(F.any_value("extra").alias("extra")))


def _disclosing(rows: DataFrame, held: DataFrame, total: int, evidence: float = EVIDENCE, generalise: float = GENERALISE, remove: float = REMOVE, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame | None:
    """term_spans of rows (text_hash, text), None where no term tells."""
    told = told_terms(held, rows.select("text"), total, evidence, generalise, remove, broadcast_terms)
    return None if told is None or told.isEmpty() else term_spans(rows, told, broadcast_terms)


def _joined(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)))")


_EVERY = "sort_array(concat(base, coalesce(extra, slice(base, 1, 0))))"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of docs.

    Positions count code points from 0, ends are exclusive. Base spans are always in spans;
    kinds ``term`` and ``term_removed`` are added wherever a term that tells stands, in
    documents without values too. Null text counts as empty; null and repeated ids and
    repeated rows are rows of their own; other columns are ignored; an empty table gives no
    rows. options: evidence, generalise, remove, broadcast_terms.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), _text_hash(text_col).alias("text_hash"))
    marked = rows.withColumn("base", _base("text")).select("_id", "text_hash", "base", F.when(F.size("base") > 0, terms_of("text")).alias("terms"))
    marked = checkpoint(marked)
    extra = _disclosing(rows.select("text_hash", "text"), marked.where(F.size("base") > 0).select("text_hash", "base", "terms"), marked.count(), **options)
    marked = marked.select("_id", "text_hash", "base")
    marked = marked.join(extra, "text_hash", "left").withColumn("every", F.expr(_EVERY)) if extra is not None else marked.withColumn("every", F.col("base"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return marked.select(F.col("_id").alias(id_col), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("every").alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS, **options) -> DataFrame:
    """docs with personal data replaced by its kind, and terms that tell generalised or removed in every document.

    Rows with neither stay as they are; null text stays null and an empty text empty. All columns are kept, whatever
    their names; repeated rows are each rewritten, and an empty table stays empty. A text's cost is linear in its
    length and its spans, however long it is. Texts are not shuffled unless more than broadcast_terms different ones hold terms that tell.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(c) for c in columns)).alias("_row"), F.col(text_col).alias("text"), _text_hash(text_col).alias("text_hash"))
    held = checkpoint(rows.select("text_hash", "text").withColumn("base", _base("text")).where(F.size("base") > 0).select("text_hash", "base", terms_of("text").alias("terms")))
    extra = _disclosing(rows.select("text_hash", "text"), held, docs.count(), broadcast_terms=broadcast_terms, **options)
    marked = rows.withColumn("base", _base("text"))
    marked = marked.join(_beside(extra, broadcast_terms), "text_hash", "left").withColumn("every", F.expr(_EVERY)) if extra is not None else marked.withColumn("every", F.col("base"))
    names = ", ".join(f"'{k}', '{v}'" for k, v in REPLACEMENTS.items())
    # What is before a span that no span has reached yet: the largest stop so far, of whole steps first. Pieces are cut from blocks of the text, so that none is looked for from its start.
    step = f"aggregate(sequence(0, size(v.t) div {_STEP}), array(0), (a, i) -> array_append(a, greatest(element_at(a, -1), coalesce(array_max(slice(v.t, i * {_STEP} + 1, {_STEP})), 0))))"
    before = lambda i: f"greatest(u.m[{i} div {_STEP}], coalesce(array_max(slice(u.t, {i} div {_STEP} * {_STEP} + 1, {i} % {_STEP})), 0))"
    piece = lambda a, z: f"if({z} <= {a}, '', substring(array_join(slice(u.p, {a} div {_BLOCK} + 1, ({z} - 1) div {_BLOCK} - {a} div {_BLOCK} + 1), ''), {a} % {_BLOCK} + 1, {z} - {a}))"
    stand_in = f"if(s.kind = 'term', s.value, map({names})[s.kind])"
    part = _bound(before("i"), "o", f"case when s.start < o then '' else concat({piece('o', 's.start')}, {stand_in}) end")
    tail = _bound(before("size(u.t)"), "o", piece("o", "u.n"))
    body = f"concat(array_join(transform(every, (s, i) -> {part}), ''), {tail})"
    with_steps = _bound(f"named_struct('t', v.t, 'p', v.p, 'n', v.n, 'm', {step})", "u", body)
    rewritten = F.expr(_bound(f"named_struct('t', transform(every, s -> s.stop), 'p', regexp_extract_all(text, {_sql(f'(?s).{{1,{_BLOCK}}}')}, 0), 'n', length(text))", "v", with_steps))
    new = F.when(F.size("every") > 0, rewritten).otherwise(F.col("text"))
    return marked.select(*(new.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in columns))
