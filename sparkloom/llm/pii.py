"""Surrogates for personal data, with DataFrame functions only.

Entities are found by patterns; a person's name is found behind a title, and then
wherever one of its words stands in the same text.  Each entity is replaced by a
surrogate of its own type that a key determines.  Letters and digits become others
of their class, so length, separators and format stay; beyond that
- an IBAN keeps its country, a card its first digit, and both a valid check digit;
- an address on the net keeps the lengths of its numbers, an e-mail address its last label;
- a secret keeps a known prefix;
- a name's words become words of the same script and case.  A first name has an
  ending of its person's gender; a word that is a family name has none.
The same entity has the same surrogate everywhere (coreference), and so has each
word of a name: Mr Smith, SMITH and Mr John Smith share one.

Distinctness.  All distinct entities (of names: words, in lower case) are gathered
with their surrogates; where two entities have one surrogate, or a surrogate is
itself an entity of the texts, all but the smallest take the next try of the keyed
function, until no collision is left.  From WIDEN tries on, surrogates grow longer
(an address on the net may have any numbers), so that a type whose format is full
of real entities ends too; MOST_TRIES would be an error.  A word that mentions
disagree on (first name of both genders, or a family name elsewhere) has the one
surrogate that most of the texts ask for.  These exceptions are joined back; the
other surrogates are computed where the entity stands.

Edge cases: null text stays null with no entities, empty text stays; a null
doc_id is kept; repeated rows are rewritten alike; an empty table gives an
empty result; extra columns are ignored.  Names in scripts without syllables below
keep their length and script, not a gender; without a title no name is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm.common import MOST_KEYS, materialize, table

KEY = "sparkloom"
WIDEN, MOST_TRIES = 4, 100

#: A word of a name: with capitals, or of a script that has none.
NAME = r"(?:\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{Lu}[\p{L}\p{M}]+)+|\p{Lu}[\p{L}\p{M}]+|\p{IsHan}{2,4}|(?!\p{IsHan})\p{Lo}[\p{Lo}\p{M}]+)"
WORD = r"[\p{L}\p{M}]+"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Titles by gender.
FEMALE = "Mrs Ms Miss Frau Mme Sra Señora Madame Госпожа Κυρία".split()
MALE = "Mr Herr Sr Señor Monsieur Господин Κύριος".split()
#: Patterns by type, in the order in which they take precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "secret": r"\b(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{32}|[0-9a-fA-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ip": rf"(?<![0-9.])(?<![Vv]ersion )(?<![Vv])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|\b[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}\b|\+[0-9]{8,14}\b",
    "name": rf"(?<= )(?=[\p{{Lu}}\p{{Lo}}])(?<=\b(?:{'|'.join(FEMALE + MALE)})\.? ){NAME}(?: {NAME})?",
}
#: Syllables that names are made of, by script; the ending tells the gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fi ga go ha jo ka ke ko la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se si so ta te ti to va vi",
    "cyrillic": "ба ве ви га да де ка ла ле ли ма ме ми на не ни ра ре ри са се си та те ти ва",
    "greek": "βα γα δα δε ζα θε κα κε λα λε λι μα με μι να νε νι πα ρα ρε ρι σα σε σι τα τε τι φα χα",
}
ENDINGS = {"latin": {"female": "na ra la ta", "male": "n r l t"}, "cyrillic": {"female": "на ра ла та", "male": "н р л т"}, "greek": {"female": "να ρα λη τη", "male": "νος ρος λης της"}}
#: Letters of other scripts, by their range in Unicode (first, step, how many).
RANGES = {
    "Han": (0x4E00, 64, 256), "Hangul": (0xAC00, 28, 256), "Hiragana": (0x304B, 1, 40), "Katakana": (0x30AB, 1, 40), "Arabic": (0x0628, 1, 17),
    "Hebrew": (0x05D0, 1, 27), "Devanagari": (0x0915, 1, 37), "Thai": (0x0E01, 1, 46), "Georgian": (0x10D0, 1, 33), "Armenian": (0x0561, 1, 38),
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def hinted(text: Column) -> Column:
    """Whether a text may hold an entity: every pattern implies one of these, and each is a plain search; null doesn't."""
    titles = [t for t in FEMALE + MALE if not any(t != o and t.startswith(o) for o in FEMALE + MALE)]
    tests = [F.contains(text, F.lit(w)) for w in ("@", "AKIA", "_", "sk-", *titles)] + [text.rlike(p) for p in (r"[0-9]{3}", r"[0-9]\.[0-9]", r"[A-Z]{2}[0-9]{2}", r"[0-9a-fA-F]{32}")]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def kind_of(e: Column) -> Column:
    """The type of an entity that was found; what no other pattern fits is a name."""
    out = None
    for kind in list(PATTERNS)[:-1]:
        test = e.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("name")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _digest(kind: Column, e: Column, tries: Column) -> Column:
    """128 keyed hex digits, enough for any entity once repeated."""
    seed = F.concat_ws("\x1f", F.lit(KEY), kind, F.lower(e), tries.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _nibble(d: Column, i: Column) -> Column:
    """Two hex digits of the digest as a number, by position."""
    at = (F.pmod(i * 2, F.lit(126)) + 1).cast("int")
    return F.conv(d.substr(at, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.lit(alphabet).substr((F.pmod(n, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _char(c: Column, n: Column, hexed: Column) -> Column:
    """A character of the same class, chosen by n."""
    return (
        F.when(c.rlike("[0-9]"), _pick("0123456789", n))
        .when(hexed & c.rlike("[a-f]"), _pick("abcdef", n))
        .when(hexed & c.rlike("[A-F]"), _pick("ABCDEF", n))
        .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n))
        .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
        .otherwise(c)
    )


def _chars(e: Column) -> Column:
    return F.split(e, "(?!^)", -1)


def _mod97(e: Column) -> Column:
    """Of letters and digits as an IBAN counts them; what is neither counts for nothing."""
    value = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a)
    return F.aggregate(_chars(e), F.lit(0), value)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _iban(e: Column, spelled: Column) -> Column:
    """The country and the spelled rest, with check digits that hold if e's do."""
    land, rest = e.substr(1, 2), spelled.substr(F.lit(5), F.length(e))
    check = F.lpad((98 - _mod97(F.concat(rest, land, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(e.substr(F.lit(5), F.length(e)), e.substr(1, 4))) == 1
    return F.concat(land, F.when(valid, check).otherwise(spelled.substr(3, 2)), rest)


def _card(e: Column, spelled: Column) -> Column:
    """The first digit and the spelled rest, with a last digit that holds if e's does."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    head = F.concat(e.substr(1, 1), spelled.substr(F.lit(2), F.length(e) - 2))
    last = F.pmod(10 - _luhn(F.concat(digits(head), F.lit("0"))), F.lit(10)).cast("string")
    return F.concat(head, F.when(_luhn(digits(e)) == 0, last).otherwise(F.substring(spelled, -1, 1)))


def _octet(o: Column, n: Column, free: Column) -> Column:
    """A number of as many digits, or any."""
    return F.when(free, n % 256).when(F.length(o) == 1, n % 9 + 1).when(F.length(o) == 2, n % 90 + 10).otherwise(n % 156 + 100).cast("string")


def _by_format(kind: Column, e: Column, tries: Column) -> Column:
    """Every letter and digit replaced by one of its class, but for what the type keeps."""
    fixed = F.when(kind == "email", F.length(F.regexp_extract(e, r"\.[A-Za-z]+$", 0))).otherwise(0)
    head = F.when(kind == "secret", F.length(F.regexp_extract(e, "^(?:AKIA|gh[pousr]_|sk-)", 0))).otherwise(0)
    more = F.floor(tries / WIDEN).cast("int")

    def spelled(d):
        keep = lambda i: (i >= F.length(e) - fixed) | (i < head) | ((kind == "phone") & (i == 1) & F.startswith(e, F.lit("+")))
        return F.concat_ws("", F.transform(_chars(e), lambda c, i: F.when(keep(i), c).otherwise(_char(c, _nibble(d, i), kind == "secret"))))

    def longer(d, s):
        letters = F.translate(F.sha2(d, 256).substr(F.lit(1), more), "0123456789", "ghijklmnop")
        digits = F.translate(F.sha2(d, 256).substr(F.lit(1), more), "abcdef", "012345")
        return F.when(kind.isin("email", "secret"), F.concat(letters, s)).otherwise(F.concat(s, digits))

    def written(d):
        octets = F.transform(F.split(e, r"\."), lambda o, i: _octet(o, _nibble(d, i) * 256 + _nibble(d, i + 9), tries >= WIDEN))
        other = _let(spelled(d), lambda s: F.when(more > 0, longer(d, s)).when(kind == "iban", _iban(e, s)).when(kind == "card", _card(e, s)).otherwise(s))
        return F.when(kind == "ip", F.concat_ws(".", octets)).otherwise(other)

    return _let(_digest(kind, e, tries), written)


def _word(w: Column, role: Column, tries: Column) -> Column:
    """A word of a name, in lower case, for one in lower case; role: female or male for a first name, else family."""
    more = F.floor(tries / WIDEN).cast("int")
    of = lambda a, n: F.element_at(a, (F.pmod(n, F.size(a)) + 1).cast("int"))

    def spell(d, script):
        s = F.array(*map(F.lit, SYLLABLES[script].split()))
        ends = {g: F.array(*map(F.lit, x.split())) for g, x in ENDINGS[script].items()}
        core = F.concat_ws("", F.transform(F.sequence(F.lit(0), 3 + more), lambda k: of(s, _nibble(d, k))))
        end = F.when(role == "female", of(ends["female"], _nibble(d, F.lit(40)))).when(role == "male", of(ends["male"], _nibble(d, F.lit(40)))).otherwise("")
        return F.concat(core, end)

    def letters(d, alphabet):
        return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(w) + more), lambda k: _pick(alphabet, _nibble(d, k))))

    def written(d):
        out = F.when(w.rlike("^[a-z]"), spell(d, "latin"))
        for script in ("cyrillic", "greek"):
            out = out.when(w.rlike(rf"\p{{Is{script.capitalize()}}}"), spell(d, script))
        for script, (first, step, n) in RANGES.items():
            out = out.when(w.rlike(rf"\p{{Is{script}}}"), letters(d, "".join(chr(first + step * i) for i in range(n))))
        return out.otherwise(spell(d, "latin"))

    return _let(_digest(role, w, tries), written)


def surrogate(e: Column, kind: Column, role: Column, tries: Column | None = None) -> Column:
    """Of a whole entity; of a name: of one word in lower case."""
    tries = F.lit(0) if tries is None else tries
    return F.when(kind == "name", _word(e, role, tries)).otherwise(_by_format(kind, e, tries))


def _cased(new: Column, w: Column) -> Column:
    """new as w is written: capitals throughout, one, or none."""
    return F.when((F.length(w) > 1) & (F.upper(w) == w), F.upper(new)).when(F.upper(w.substr(1, 1)) == w.substr(1, 1), F.initcap(new)).otherwise(new)


def _gender(before: Column) -> Column:
    return F.when(before.rlike(rf"\b(?:{'|'.join(FEMALE)})\.? $"), "female").otherwise("male")


def _words(e: Column) -> Column:
    return F.regexp_extract_all(e, F.lit(WORD), F.lit(0))


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, at, ents, rest, who): a hash of id and text, each text's entities (e, k) with their types in order, what stands around them, and the roles of its names' words.

    Words of names found behind titles are looked for in the whole text.
    """
    none = F.array().cast("array<string>")
    typed = lambda pattern: F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), lambda e: F.struct(e.alias("e"), kind_of(e).alias("k")))
    found = docs.select("doc_id", "text", typed(F.lit(_ANY)).alias("first"))
    words = F.flatten(F.transform(F.filter("first", lambda x: x["k"] == "name"), lambda x: _words(x["e"])))
    found = found.withColumn("names", F.when(F.size("first") > 0, F.filter(F.array_distinct(words), lambda w: F.length(w) > 1)).otherwise(none))
    alone = F.concat(F.lit(_ANY + r"|(?<![\p{L}\p{M}])(?:"), F.array_join("names", "|"), F.lit(r")(?![\p{L}\p{M}])"))
    pattern = F.when(F.size("names") > 0, alone).otherwise(F.lit(_ANY))
    found = found.withColumn("ents", F.when(F.size("names") > 0, typed(pattern)).otherwise(F.col("first")))
    found = found.withColumn("rest", F.split("text", pattern, -1))
    titled = rf"\b(?:{'|'.join(FEMALE + MALE)})\.? $"
    told = F.transform(
        "ents",
        lambda x, i: F.when(
            (x["k"] == "name") & F.element_at("rest", i + 1).rlike(titled),
            F.transform(_words(x["e"]), lambda w, k: F.struct(F.lower(w).alias("w"), F.when((k == 0) & x["e"].contains(" "), _gender(F.element_at("rest", i + 1))).otherwise("family").alias("role"))),
        ).otherwise(F.array().cast("array<struct<w:string,role:string>>")),
    )
    who = F.when(F.size("names") > 0, F.flatten(told)).otherwise(F.array().cast("array<struct<w:string,role:string>>"))
    return found.select("doc_id", F.xxhash64("doc_id", "text").alias("at"), "ents", "rest", who.alias("who"))


def _role(w: Column) -> Column:
    """What a text takes a word of a name for: what its first mention behind a title says."""
    return F.coalesce(F.get(F.filter("who", lambda x: x["w"] == w), F.lit(0))["role"], F.lit("family"))


def _entities(found: DataFrame) -> DataFrame:
    """Distinct (entity, kind, role, both): of names each word in lower case, with the role that most texts say; both marks words on which they disagree."""
    part = lambda e, kind, role: F.struct(e.alias("entity"), kind.alias("kind"), role.alias("role"))
    words = lambda x: F.transform(_words(x["e"]), lambda w: part(F.lower(w), F.lit("name"), _role(F.lower(w))))
    own = lambda x: F.when(x["k"] == "name", words(x)).otherwise(F.array(part(x["e"], x["k"], F.lit("whole"))))
    each = found.select(F.explode(F.array_distinct(F.flatten(F.transform("ents", own)))).alias("p")).select("p.*")
    flat = each.groupBy("entity", "kind", "role").agg(F.count("*").alias("n"))
    return flat.groupBy("entity", "kind").agg(F.max_by("role", F.struct("n", "role")).alias("role"), (F.count("*") > 1).alias("both"))


def exceptions(entities: DataFrame) -> DataFrame:
    """(entity, kind, s) of entities whose first surrogate would collide, and of words of names that have several roles."""
    made = surrogate(F.col("entity"), F.col("kind"), F.col("role"), F.col("tries"))
    held = materialize(entities.withColumn("tries", F.lit(0)).withColumn("s", made))
    for _ in range(MOST_TRIES):
        taken = held.select(F.col("entity").alias("s"), F.lit(True).alias("real")).distinct()
        w = W.partitionBy("s").orderBy("tries", "entity", "kind")
        clash = materialize(held.withColumn("r", F.row_number().over(w)).join(taken, "s", "left").where("r > 1 OR real").select("entity", "kind", F.lit(1).alias("again")))
        if clash.isEmpty():
            return held.where("tries > 0 OR both").select("entity", "kind", "s")
        # only those that collide are spelled anew
        again = held.drop("s").join(clash, ["entity", "kind"]).withColumn("tries", F.col("tries") + 1).drop("again").withColumn("s", made)
        held = materialize(held.join(clash, ["entity", "kind"], "left_anti").unionByName(again))
    raise ValueError(f"no distinct surrogates after {MOST_TRIES} tries")


def pseudonymize(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): the rewritten text and how many entities it held."""
    # a cheap test of the whole text comes first, as most texts hold no entity; what the others hold is found once
    hint = hinted(F.col("text"))
    none = docs.where(~hint).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    found = materialize(_found(docs.where(hint)))
    entities = materialize(_entities(found))
    odd = materialize(exceptions(entities))
    empty = F.create_map().cast("map<string,string>")
    if odd.isEmpty():
        found = found.withColumn("own", empty)
    else:
        # a word of a name and another entity may be written alike: the words' keys begin with a mark
        odd = odd.select(F.when(F.col("kind") == "name", F.concat(F.lit("\x1f"), "entity")).otherwise(F.col("entity")).alias("entity"), "s")
        marked = lambda x: F.when(x["k"] == "name", F.transform(_words(x["e"]), lambda w: F.concat(F.lit("\x1f"), F.lower(w)))).otherwise(F.array(x["e"]))
        keyed = found.select("at", F.explode(F.array_distinct(F.flatten(F.transform("ents", marked)))).alias("entity"))
        few = odd.count() <= MOST_KEYS
        own = keyed.join(F.broadcast(odd) if few else odd, "entity").select("at", "entity", "s").distinct().groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("entity", "s"))).alias("own"))
        own = materialize(own)
        few = own.count() <= MOST_KEYS // 10
        found = found.join(F.broadcast(own) if few else own, "at", "left").withColumn("own", F.coalesce("own", empty))
    word = lambda w: _cased(F.coalesce(F.element_at("own", F.concat(F.lit("\x1f"), F.lower(w))), _word(F.lower(w), _role(F.lower(w)), F.lit(0))), w)
    between = lambda e: F.split(e, WORD, -1)
    name = lambda e: F.concat_ws("", F.flatten(F.zip_with(between(e), F.transform(_words(e), word), lambda r, s: F.array(r, F.coalesce(s, F.lit(""))))))
    swaps = F.transform("ents", lambda x: F.when(x["k"] == "name", name(x["e"])).otherwise(F.coalesce(F.element_at("own", x["e"]), _by_format(x["k"], x["e"], F.lit(0)))))
    put = F.concat_ws("", F.flatten(F.zip_with("rest", swaps, lambda r, s: F.array(r, F.coalesce(s, F.lit(""))))))
    return found.select(
        "doc_id",
        put.alias("text"),
        F.size("ents").cast("long").alias("n_entities"),
    ).union(none)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"))
