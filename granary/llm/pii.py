"""Surrogates for personal data (operator 5), in DataFrame functions only.

Entities are found by one pattern of alternatives and replaced by surrogates
that a keyed hash derives from the entity in its canonical form, so the same
entity gets the same surrogate wherever it occurs and nothing has to be looked
up. Digits become digits and letters letters of the same script and case, while
separators, lengths and types stay; mail goes to reserved domains, addresses to
a reserved network, and a name after a title becomes a name of the title's
gender. All distinct entities are then checked against one another and against
the surrogates, in every form they are written in: where two would share a
surrogate, or a surrogate is someone's real entity, the later in order takes the next one of its sequence, and those
few exceptions go into the replacement. After ROUNDS such turns a shape is taken
as crowded: its next surrogates are longer (addresses come from wider reserved
networks), and the turns go on until every entity has one of its own.

Card and bank account numbers get the check digits that their types ask for. The
key is the session's spark.granary.pii.key, where no other is given.

Defined results: a null text stays null with no entities; text outside of
entities is kept byte for byte; entities that touch letters or digits on either
side are not entities; rows that repeat are each rewritten. An entity may be of
any length: what is after its first LETTERS places is drawn in whole stretches.
Further columns of the input are kept by `rewrite`, whatever their names, and
not read by `surrogates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.arrow import unused
from granary.plans.staging import stage

#: The key for tests, where the session's configuration names none.
KEY = "granary-demo-key"
#: Exceptions that may go into the plan as one map; above it they are joined to the mentions.
MAP_BOUND = 10_000
#: Surrogates of the entity's own shape that are tried before wider ones are.
ROUNDS = 12
#: Places of an entity that are drawn one by one.
LETTERS = 512

# Titles by gender, and names that stand in for names.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora"], "any": ["Dr", "Prof", "Professor"]}
NAMES = {
    "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"],
    "f": ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"],
}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# The types and their patterns, in order of precedence.
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}"),
    ("secret", r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{8,}[\"']?"),
    ("aws_key", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
    ("ip", rf"{_OCTET}(?:\.{_OCTET}){{3}}"),
    ("ssn", r"\d{3}-\d{2}-\d{4}"),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}"),
    ("phone", r"\(\d{3}\) ?\d{3}[-.]\d{4}"),
    ("phone", r"\d{3}[-.]\d{3}[-.]\d{4}"),
    ("card", r"\d{4}(?:[ -]?\d{4}){3}"),
    ("card", r"\d{13,19}"),
    ("name", rf"(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?"),
]
ENTITY = r"(?<![\p{L}\p{N}_+.@-])(?:" + "|".join(p for _, p in PATTERNS) + r")(?![\p{L}\p{N}_@])"
#: What every entity holds; texts without it are passed over.
HINT = r"[@0-9=:]|" + rf"(?:{_TITLE})\b"


def kind_of(entity: Column) -> Column:
    """The type of a string that ENTITY has matched."""
    out = F.lit("name")
    for name, p in reversed(PATTERNS[:-1]):
        out = F.when(entity.rlike(rf"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def canonical(entity: Column, kind: Column) -> Column:
    """What two mentions of one entity have in common: letters' case does not matter in mail and names, nor separators in numbers."""
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(entity, r"[ ().-]", ""))
        .when(kind == "email", F.lower(entity))
        .when(kind == "name", F.lower(F.regexp_replace(entity, rf"^(?:{_TITLE})\.? ", "")))
        .when(kind == "secret", F.regexp_extract(entity, r"([A-Za-z0-9_/+-]{8,})[\"']?$", 1))
        .otherwise(entity)
    )


def _stream(kind: Column, canon: Column, nonce: Column, key: str) -> Column:
    """512 hex digits that the key, the type, the entity and its nonce fix."""
    base = F.concat_ws("\u0001", F.lit(key), kind, canon, nonce.cast("string"))
    return F.concat(*(F.sha2(F.concat(F.lit(f"{i}:"), base), 512) for i in range(4)))


def _draw(hexes: Column, i: Column, modulo) -> Column:
    """The i-th draw below modulo, from five hex digits."""
    return F.conv(F.substr(hexes, (i * 5) % 500 + 1, F.lit(5)), 16, 10).cast("int") % modulo


#: Country codes, which phone numbers keep; they are read off the digits, whatever stands between these.
_CODE = r"^(\+" + r"(?:1|7|2~[07]|3~[0-469]|4~[013-9]|5~[1-8]|6~[0-6]|8~[1246]|9~[0-58]|\d~\d~\d))".replace("~", r"[ .()-]*")
# Digits, and letters of the scripts whose letters are replaced within the script and case; letters of others become Latin ones of their case.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՒՓՔՕՖ"]
ALPHABETS += ALPHABETS[1:3]
_SETS = r"^(?:(\d)|" + "|".join(rf"([\p{{Is{x}}}&&\p{{L}}&&[^\p{{Lu}}]])|([\p{{Is{x}}}&&\p{{Lu}}])" for x in ("Latin", "Cyrillic", "Greek", "Armenian")) + r"|([\p{L}&&[^\p{Lu}]])|(\p{Lu}))$"


def _masked(text: Column, hexes: Column, lower: Column) -> Column:
    """text with digits and letters drawn anew; the draw for one depends on its rank among them only.

    lower: from how many of the letters a-z those in their place are drawn.
    """
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc, c):
        drawn = c
        for i, a in reversed([*enumerate(ALPHABETS, 1)]):  # digits and Latin letters are tried first
            many = lower if i == 2 else F.lit(len(a))
            drawn = F.when(F.regexp_extract(c, _SETS, i) != "", F.substr(F.lit(a), _draw(hexes, acc["n"], many) + 1, F.lit(1))).otherwise(drawn)
        return F.struct(F.concat(acc["out"], F.when(c.rlike(_SETS), drawn).otherwise(c)).alias("out"), (acc["n"] + c.rlike(_SETS).cast("int")).alias("n"))

    # A very long entity's rest is a run of the entity's hex digits, so that the cost stays in proportion to its length.
    rest = F.greatest(F.length(text) - LETTERS, F.lit(0))
    tail = F.substr(F.repeat(hexes, F.ceil(rest / 512).cast("int")), F.lit(1), rest)
    return F.concat(F.aggregate(F.split(F.substring(text, 1, LETTERS), ""), state, step, lambda acc: acc["out"]), tail)


def _digits(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def luhn_checked(card: Column) -> Column:
    """A card number whose last digit is its check digit; separators stay."""
    body = F.reverse(_digits(F.regexp_replace(F.regexp_replace(card, r"\D", ""), r".$", "")))
    worth = F.transform(body, lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    check = F.pmod(10 - F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10, F.lit(10))
    return F.concat(F.substr(card, F.lit(1), F.length(card) - 1), check.cast("string"))


def iban_checked(iban: Column) -> Column:
    """A bank account number with the two check digits after its country code."""
    flat = F.regexp_replace(iban, " ", "")
    turned = _digits(F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(2)), F.lit("00")))
    left = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.try_to_number(c, F.lit("9")).cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)
    return F.concat(F.substr(iban, F.lit(1), F.lit(2)), F.lpad((98 - left).cast("string"), 2, "0"), F.substr(iban, F.lit(5)))


def _parts(m: Column) -> Column:
    """struct(head, body, tail) of one mention m (entity, kind, nonce, h): a head and a tail ready to stand, a body to be masked."""
    e, kind, h = m["entity"], m["kind"], m["h"]
    n = lambda i, most: _draw(h, F.lit(i), most)
    mail = F.concat(F.lit("@mail"), n(70, 100000).cast("string"), F.element_at(F.array(F.lit(".example.com"), F.lit(".example.net"), F.lit(".example.org")), n(71, 3) + 1))
    octets = [n(i, 256).cast("string") for i in range(3)]
    groups = [F.lower(F.hex(n(i, 65536))) for i in range(6)]
    ip = (
        F.when(m["nonce"] < ROUNDS, F.concat_ws(".", F.lit("10"), *octets))
        .when(m["nonce"] < 2 * ROUNDS, F.concat_ws(".", (n(3, 16) + 240).cast("string"), *octets))
        .otherwise(F.concat_ws(":", F.lit("2001"), F.lit("db8"), *groups))
    )
    title = F.regexp_extract(e, rf"^((?:{_TITLE})\.? )", 1)
    bare = F.rtrim(F.regexp_replace(title, r"\.", ""))
    female = F.when(bare.isin(TITLES["any"]), n(81, 2) == 1).otherwise(bare.isin(TITLES["f"]))
    given = F.element_at(F.when(female, F.array(*map(F.lit, NAMES["f"]))).otherwise(F.array(*map(F.lit, NAMES["m"]))), n(80, len(NAMES["m"])) + 1)
    # The first of two names in Latin letters becomes a given name; a name in another script is masked in its script.
    first = F.regexp_extract(e, rf"^(?:{_TITLE})\.? ([\p{{IsLatin}}'’-]+ )", 1)
    head = (
        F.when(kind == "email", "").when(kind == "ip", ip)
        .when(kind == "name", F.concat(title, F.when(first != "", F.concat(given, F.lit(" "))).otherwise("")))
        .when(kind == "secret", F.regexp_extract(e, r"^([^=:]*[=:]\s*[\"']?)", 1))
        .when(kind == "iban", F.substring(e, 1, 2)).when(kind == "aws_key", F.substring(e, 1, 4))
        .when(kind == "phone", F.regexp_extract(e, _CODE, 1)).when(kind == "card", F.substring(e, 1, 1)).otherwise("")
    )
    skip = F.when(kind == "name", F.length(title) + F.length(first)).otherwise(F.length(head))
    body = F.when(kind == "email", F.regexp_extract(e, r"^([^@]*)@", 1)).when(kind == "ip", "").otherwise(F.substr(e, skip + 1))
    # A crowded shape: the last letter or digit once more, and again after every two turns.
    last = r"(?s)^(.*([\p{L}\p{N}]))([^\p{L}\p{N}]*)$"
    part = lambda i: F.regexp_extract(body, last, i)
    more = F.floor((m["nonce"] - ROUNDS) / 2).cast("int") + 1
    body = F.when(m["nonce"] < ROUNDS, body).otherwise(F.concat(part(1), F.repeat(part(2), more), part(3)))
    return F.struct(head.alias("head"), body.alias("body"), F.when(kind == "email", mail).otherwise("").alias("tail"), h.alias("h"), F.when((kind == "secret") & ~body.rlike("[g-z]"), 6).otherwise(26).alias("lower"), kind.alias("kind"))


def surrogates(found: Column, key: str = KEY) -> Column:
    """array<string> of the replacements of an array of struct(entity, kind, canon, nonce)."""
    hashed = F.transform(found, lambda m: F.struct(m["entity"].alias("entity"), m["kind"].alias("kind"), m["nonce"].alias("nonce"), _stream(m["kind"], m["canon"], m["nonce"], key).alias("h")))
    parts = F.transform(hashed, _parts)
    made = F.transform(parts, lambda m: F.struct(m["kind"].alias("kind"), F.concat(m["head"], _masked(m["body"], m["h"], m["lower"]), m["tail"]).alias("text")))
    return F.transform(made, lambda m: F.when(m["kind"] == "card", luhn_checked(m["text"])).when(m["kind"] == "iban", iban_checked(m["text"])).otherwise(m["text"]))


def described(entities: Column, nonce_of=lambda kind, canon, at: F.lit(0)) -> Column:
    """array of struct(entity, kind, canon, nonce) of an array of entities."""
    kinds = F.transform(entities, lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    canons = F.transform(kinds, lambda m: F.struct(m["entity"].alias("entity"), m["kind"].alias("kind"), canonical(m["entity"], m["kind"]).alias("canon")))
    return F.transform(canons, lambda m, i: F.struct(m["entity"].alias("entity"), m["kind"].alias("kind"), m["canon"].alias("canon"), nonce_of(m["kind"], m["canon"], i).alias("nonce")))


def mentions(text: Column) -> Column:
    """array<string> of the entities of a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _distinct_entities(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, canon, form): every written form of every entity once."""
    found = docs.select(F.explode(mentions(F.col(text_col))).alias("form")).distinct()
    return found.select(F.explode(described(F.array("form"))).alias("m")).select("m.kind", "m.canon", F.col("m.entity").alias("form"))


def exceptions(docs: DataFrame, text_col: str = "text", key: str = KEY) -> tuple[DataFrame, int]:
    """Staged (kind, canon, nonce) of the entities whose first surrogate is not theirs alone, and their number.

    A surrogate is compared in its canonical form, so that two entities never
    end as one, and no surrogate is another entity of the corpus.
    """
    known = stage(_distinct_entities(docs, text_col), "entities")
    real = stage(known.select("kind", F.col("canon").alias("new")).distinct(), "real").withColumn("is_real", F.lit(True))
    now = known.withColumn("nonce", F.lit(0))
    taken = None
    while True:
        one = F.array(F.struct(F.col("form").alias("entity"), "kind", "canon", "nonce"))
        made = now.select("kind", "canon", "nonce", F.explode(surrogates(one, key)).alias("made"))
        made = stage(made.select("kind", "canon", "nonce", canonical(F.col("made"), F.col("kind")).alias("new")).distinct(), "surrogates")
        held = made.join(real, ["kind", "new"], "left")
        if taken is not None:
            held = held.join(taken.select("kind", "new", F.lit(True).alias("is_taken")), ["kind", "new"], "left")
        else:
            held = held.withColumn("is_taken", F.lit(None).cast("boolean"))
        first = stage(made.groupBy("kind", "new").agg(F.min("canon").alias("owner")), "owners")
        held = held.join(first, ["kind", "new"])
        good = F.col("is_real").isNull() & F.col("is_taken").isNull() & (F.col("canon") == F.col("owner"))
        # An entity settles with all its forms or with none.
        judged = stage(held.groupBy("kind", "canon", "nonce").agg(F.every(good).alias("good")), "judged")
        fresh = stage(made.join(judged.where("good"), ["kind", "canon", "nonce"]).select("kind", "canon", "nonce", "new"), "settled")
        taken = fresh if taken is None else taken.union(fresh)
        again = judged.where("not good").select("kind", "canon", (F.col("nonce") + 1).alias("nonce"))
        if not again.limit(1).count():
            break
        now = known.join(again, ["kind", "canon"])
    out = stage(taken.where("nonce > 0").select("kind", "canon", "nonce").distinct(), "exceptions")
    return out, out.count()


def _rebuilt(text: Column, found: Column, new: Column) -> Column:
    """text with its i-th entity replaced by the i-th of new."""
    between = F.split(text, ENTITY, -1)
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""))


def rewrite(docs: DataFrame, text_col: str = "text", key: str | None = None, map_bound: int = MAP_BOUND) -> DataFrame:
    """docs with text_col rewritten, and two columns more: _n_entities int and _kinds array<string>, one kind for each entity.

    Columns of docs that have those names already are replaced; all others stay.
    """
    key = docs.sparkSession.conf.get("spark.granary.pii.key", KEY) if key is None else key
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("_n_entities", "_kinds")))
    given = docs.columns
    found, new, odd_map, nonces, row = (unused(given, x) for x in ("_found", "_new", "_odd", "_nonces", "_row"))
    odd, n = exceptions(docs, text_col, key)
    text = F.col(text_col)
    out = docs.withColumn(found, F.coalesce(mentions(text), F.array().cast("array<string>")))

    if n == 0:
        nonce_of = lambda kind, canon, at: F.lit(0)
    elif n <= map_bound:
        entry = F.struct(F.concat_ws("\u0001", "kind", "canon"), "nonce")
        table = odd.agg(F.map_from_entries(F.collect_list(entry)).alias(odd_map))
        out = out.join(F.broadcast(table), how="cross")  # one row of at most map_bound entries
        nonce_of = lambda kind, canon, at: F.coalesce(F.try_element_at(F.col(odd_map), F.concat_ws("\u0001", kind, canon)), F.lit(0))
    else:
        # Only rows with an exception among their entities are shuffled, each mention with its nonce.
        out = out.withColumn(row, F.monotonically_increasing_id())
        out = stage(out, "pii-rows")
        spread = out.select(F.col(row).alias("_row"), F.posexplode(described(F.col(found))).alias("_at", "m")).select("_row", "_at", "m.kind", "m.canon")
        some = spread.join(odd, ["kind", "canon"]).groupBy(F.col("_row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("_at", odd["nonce"]))).alias(nonces))
        out = out.join(some, row, "left").drop(row)
        nonce_of = lambda kind, canon, at: F.coalesce(F.try_element_at(F.col(nonces), at), F.lit(0))

    out = out.withColumn(found, described(F.col(found), nonce_of))
    out = out.withColumn(new, surrogates(F.col(found), key))
    out = out.withColumn(text_col, _rebuilt(text, F.col(found), F.col(new)))
    out = out.withColumn("_n_entities", F.size(found)).withColumn("_kinds", F.transform(found, lambda m: m["kind"]))
    return out.select(*given, "_n_entities", "_kinds")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, the rewritten text, how many entities it had and their kinds."""
    out = rewrite(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_entities").alias("n_entities"), F.col("_kinds").alias("kinds"))
