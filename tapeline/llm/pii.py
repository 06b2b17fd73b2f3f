"""Personal data and secrets give way to keyed surrogates, by DataFrame functions alone.

One pattern finds mentions of e-mail addresses, IP addresses, phone, card, account and
social security numbers, access keys, secrets and titled names. A mention belongs to an
entity: its type and its normal form (an address in lower case, a number without
separators, a name by its parts), so that mentions in other clothes stay one person.

An entity's surrogate comes from SHA-256 over a key, the type, the normal form and an
attempt number. Letters stay letters and digits digits; phone numbers keep their country
code, addresses get a reserved domain, octets stay below 256, given names keep the gender
that the title tells and names their script. A mention is rendered in its own format:
separators, capitals and spacing stay.

Collision check: over the distinct entities of the whole input, two entities of a type
never share a surrogate and no surrogate equals an entity that occurs. Whatever collides
takes the next attempt until nothing does. Equal entities have equal surrogates in all
documents, and the same key gives the same surrogates in another run over the same input.

Null and empty texts stay as they are. Replacements depend on the text alone, so rows
that repeat an id or a text are replaced alike. Other columns stay, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize

# Titles tell the gender of a given name; fixed values.
MALE = "Mr|Herr|Monsieur|Señor"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora"
MALE_CYRILLIC = "господин|г-н"
FEMALE_CYRILLIC = "госпожа|г-жа"
NEUTRAL = "Dr|Prof"

SECRETS = "password|passwd|secret|api_key|apikey|token"

# Quantifiers are bounded, possessive or start at a word boundary, so that long runs stay
# linear.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ACCESS_KEY": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "API_KEY": r"\b(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}+",
    "HEX_SECRET": r"\b(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)\b",
    # with blanks around the sign, as in prose, a secret has a digit or a symbol
    "PASSWORD": rf"(?i:{SECRETS})(?:[=:]|[ \t]{{0,3}}[=:][ \t]{{0,3}}(?=[^\s\"'=:]*[0-9!#$%&*+@^_~]))[^\s\"'=:]{{6,}}+",
    "IBAN": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "IP": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "PHONE": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}\b"
    r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b|\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b",
    "SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "CARD": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "NAME": rf"(?:\b(?:{MALE}|{FEMALE}|{NEUTRAL})\.?|{MALE_CYRILLIC}|{FEMALE_CYRILLIC})"
    r" \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?",
}
FIND = "|".join(PATTERNS.values())
# What every mention without a digit or @ holds: texts without either are passed over.
WITHOUT_DIGITS = (
    rf"(?i:{SECRETS})[ \t]{{0,3}}[=:]|AKIA|ASIA|\b(?:sk|pk|ghp|gho|xoxb|xoxp)[-_]"
    rf"|[a-f]{{32}}|[A-F]{{32}}|(?:{MALE}|{FEMALE}|{NEUTRAL}|{MALE_CYRILLIC}|{FEMALE_CYRILLIC})\.? \p{{Lu}}"
)
#: Attempts at surrogates that are distinct and no one's own mention.
ROUNDS = 100
KEYWORD = r"^[A-Za-z_]+[ \t]{0,3}[=:][ \t]{0,3}"

# Names to choose from, by gender and script; fixed values.
GIVEN = {
    "GIVEN_M_LATIN": "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leon Marco Noah Oskar Paul",
    "GIVEN_F_LATIN": "Anna Berta Clara Diana Elena Flora Greta Helena Ines Julia Karla Laura Maria Nora Olga Paula",
    "GIVEN_N_LATIN": "Alex Robin Sascha Kim Noel Jules Andrea Dominique Eli Jean Jona Kaya Luca Mika Remy Toni",
    "GIVEN_M_CYRILLIC": "Антон Борис Виктор Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан Тимур Фёдор",
    "GIVEN_F_CYRILLIC": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья",
    "GIVEN_N_CYRILLIC": "Женя Саша Валя Шура Слава Тоня Витя Вася Паша Миша Лёша Коля Гоша Дима Рита Яна",
}
SYLLABLES = {
    "LATIN": "ba be bo da de do fa fe ga ge ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te",
    "CYRILLIC": "ба бе бо да де до фа фе га ге ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те",
}


def _type_of(mention: Column) -> Column:
    """The first type whose pattern covers the mention."""
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{p})$"), F.lit(t)) for t, p in PATTERNS.items()])


def _may_mention(text: Column) -> Column:
    """True for every text with a mention and for some others, at little cost."""
    return F.coalesce(text.rlike("[0-9@]") | text.rlike(WITHOUT_DIGITS), F.lit(False))


def _parts(mention: Column, kind: Column) -> Column:
    """Parts of a mention that are replaced on their own: (type, text); type null: kept."""
    words = F.split(mention, " ")
    title = F.element_at(words, 1)
    gender = (
        F.when(title.rlike(rf"^(?:{MALE}|{MALE_CYRILLIC})\.?$"), "M")
        .when(title.rlike(rf"^(?:{FEMALE}|{FEMALE_CYRILLIC})\.?$"), "F")
        .otherwise("N")
    )

    def script(word: Column) -> Column:
        return F.when(word.rlike(r"^\p{IsCyrillic}"), "CYRILLIC").otherwise("LATIN")

    def part(word: Column, place: Column) -> Column:
        given = (place == 1) & (F.size(words) == 3)
        name = F.when(given, F.concat(F.lit("GIVEN_"), gender, F.lit("_"), script(word))).otherwise(
            F.concat(F.lit("SURNAME_"), script(word))
        )
        return F.struct(F.when(place > 0, name).alias("type"), word.alias("text"))

    whole = F.array(F.struct(kind.alias("type"), mention.alias("text")))
    return F.when(kind == "NAME", F.transform(words, part)).otherwise(whole)


def _normal(kind: Column, text: Column) -> Column:
    """The form by which mentions are the same entity."""
    return (
        F.when(kind == "EMAIL", F.lower(text))
        .when(kind.isin("PHONE", "CARD", "IBAN", "SSN"), F.regexp_replace(text, "[^0-9A-Za-z]", ""))
        .when(kind == "PASSWORD", F.regexp_replace(text, KEYWORD, ""))
        .otherwise(text)
    )


def _digest(key: str, kind: Column, normal: Column, attempt: Column, length: Column) -> Column:
    """Hex digits, two for each of ``length`` characters at least."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.floor(length / 32).cast("int")),
            lambda j: F.sha2(
                F.concat_ws("\u0001", F.lit(key), kind, attempt.cast("string"), j.cast("string"), normal), 256
            ),
        ),
        "",
    )


def _number(digest: Column, place: Column, width: int = 2) -> Column:
    """The number that ``width`` hex digits make, at place 0, 1, ..."""
    return F.conv(F.substr(digest, place * width + 1, F.lit(width)), 16, 10).cast("int")


def _recoded(
    text: Column, digest: Column, keep: Column | None = None, symbols: Column | None = None
) -> Column:
    """Each digit by a digit and each letter by a letter of its case; the first ``keep`` stay.

    Letters of other scripts become Latin ones, and so do symbols where ``symbols`` holds.
    """
    letters, capitals = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        new = (
            F.when(c.between("0", "9"), (n % 10).cast("string"))
            .when(c.between("a", "z"), F.substr(F.lit(letters), n % 26 + 1, F.lit(1)))
            .when(c.between("A", "Z"), F.substr(F.lit(capitals), n % 26 + 1, F.lit(1)))
            .when(
                c.rlike(r"[^\x00-\x7F]") | (F.lit(False) if symbols is None else symbols),
                F.substr(F.lit(letters), n % 26 + 1, F.lit(1)),
            )
            .otherwise(c)
        )
        return new if keep is None else F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _word(words: str, n: Column) -> Column:
    values = words.split()
    return F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)


def _surrogate(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """The normal form of an entity's surrogate."""
    digest = _digest(key, kind, normal, attempt, F.length(normal))
    local = F.substring_index(normal, "@", 1)
    letters = F.transform(
        F.sequence(F.lit(24), F.lit(30)),
        lambda i: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _number(digest, i) % 26 + 1, F.lit(1)),
    )
    octets = F.concat_ws(
        ".", *[(_number(digest, F.lit(i)) % (223 if i == 0 else 256) + int(i == 0)).cast("string") for i in range(4)]
    )
    hexes = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.length(normal) - 1),
            lambda i: F.substr(F.lit("0123456789abcdef"), _number(digest, i) % 16 + 1, F.lit(1)),
        ),
        "",
    )
    chosen = (
        F.when(kind == "EMAIL", F.concat(_recoded(local, digest), F.lit("@"), F.array_join(letters, ""), F.lit(".example")))
        .when(kind == "IP", octets)
        .when(kind == "HEX_SECRET", F.when(normal.rlike("[A-F]"), F.upper(hexes)).otherwise(hexes))
        .when(kind == "PHONE", _recoded(normal, digest, F.greatest(F.length(normal) - 10, F.lit(0))))
        .when(kind == "IBAN", F.concat(F.substring(normal, 1, 2), F.substr(_recoded(normal, digest), F.lit(3))))
        .when(kind == "ACCESS_KEY", F.concat(F.substring(normal, 1, 4), F.substr(_recoded(normal, digest), F.lit(5))))
    )
    for script, syllables in SYLLABLES.items():
        # each attempt adds a syllable, so names never run out
        tail = F.array_join(
            F.transform(F.sequence(F.lit(1), attempt + 3), lambda i: _word(syllables, _number(digest, i % 31))), ""
        )
        chosen = chosen.when(kind == f"SURNAME_{script}", F.initcap(tail))
        more = F.array_join(
            F.transform(F.sequence(F.lit(1), attempt), lambda i: _word(syllables, _number(digest, i % 31))), ""
        )
        more = F.when(attempt > 0, more).otherwise("")
        for gender in "MFN":
            name = f"GIVEN_{gender}_{script}"
            chosen = chosen.when(kind == name, F.concat(_word(GIVEN[name], _number(digest, F.lit(0))), more))
    # a mention of symbols alone differs from its surrogate from the second attempt on
    return chosen.otherwise(_recoded(normal, digest, symbols=attempt > 0))


def _rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """A surrogate in the clothes of the mention: separators and capitals."""
    local = F.length(F.substring_index(mention, "@", 1))
    domain = F.substring_index(mention, "@", -1)
    cased = F.transform(
        F.split(F.substr(surrogate, F.lit(1), local), ""),
        lambda c, i: F.when(F.substr(mention, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c),
    )
    rest = F.substr(surrogate, local + 1)
    email = F.concat(
        F.array_join(cased, ""), F.when(domain == F.upper(domain), F.upper(rest)).otherwise(rest)
    )
    spaced = F.array_join(
        F.transform(
            F.split(mention, ""),
            lambda c, i: F.when(
                c.rlike("[0-9A-Za-z]"),
                F.substr(
                    surrogate,
                    F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), "[^0-9A-Za-z]", "")) + 1,
                    F.lit(1),
                ),
            ).otherwise(c),
        ),
        "",
    )
    return (
        F.when(kind.isNull(), mention)
        .when(kind == "EMAIL", email)
        .when(kind.isin("PHONE", "CARD", "IBAN", "SSN"), spaced)
        .when(kind == "PASSWORD", F.concat(F.regexp_extract(mention, KEYWORD, 0), surrogate))
        .otherwise(surrogate)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """type, normal, surrogate for distinct entities, free of collisions.

    Each round writes its table; only entities that collided change in the next one. Each
    attempt draws anew, so rounds without end would mean that a type's surrogates ran out.
    """
    table = entities.select("type", "normal").distinct().withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        table = table.withColumn(
            "surrogate", _surrogate(key, F.col("type"), F.col("normal"), F.col("attempt"))
        )
        table = materialize(table, "surrogates")
        first = table.groupBy(F.col("type").alias("t"), F.col("surrogate").alias("s")).agg(
            F.min(F.struct("attempt", "normal")).alias("first"), F.count("*").alias("n")
        )
        taken = table.select(F.col("type").alias("t"), F.col("normal").alias("s"))
        shared = first.where("n > 1").select("t", "s", F.col("first.normal").alias("owner"))
        real = taken.select("t", "s", F.lit(None).cast("string").alias("owner"))
        clash = (
            table.join(
                shared.unionByName(real),
                (F.col("type") == F.col("t")) & (F.col("surrogate") == F.col("s")),
            )
            .where("owner IS NULL OR owner <> normal")
            .select("type", "normal")
            .distinct()
        )
        clash = materialize(clash, "collisions")
        if clash.isEmpty():
            return table.select("type", "normal", "surrogate")
        again = clash.select(F.col("type").alias("t"), F.col("normal").alias("s"))
        table = table.join(
            again, (F.col("type") == F.col("t")) & (F.col("normal") == F.col("s")), "left"
        ).select(
            "type", "normal", (F.col("attempt") + F.col("t").isNotNull().cast("int")).alias("attempt")
        )
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each part of a mention in each distinct text.

    text_key (hash of the text), place, part, mentions of the text, type (null: the part
    is kept), part_text and normal.
    """
    text = docs[text_col]
    found = docs.where(_may_mention(text)).select(F.unhex(F.md5(text.cast("binary"))).alias("text_key"), F.regexp_extract_all(text, F.lit(FIND), F.lit(0)).alias("found"))
    found = found.where(F.size("found") > 0).groupBy("text_key").agg(F.first("found").alias("found"))
    rows = found.select("text_key", F.posexplode("found").alias("place", "mention"))
    rows = rows.withColumn("kind", _type_of(F.col("mention")))
    rows = rows.select(
        "text_key", "place", F.posexplode(_parts(F.col("mention"), F.col("kind"))).alias("part", "piece")
    )
    return rows.select(
        "text_key",
        "place",
        "part",
        F.col("piece.type").alias("type"),
        F.col("piece.text").alias("part_text"),
        _normal(F.col("piece.type"), F.col("piece.text")).alias("normal"),
    )


def replace_pii(docs: DataFrame, text_col: str = "text", key: str = "tapeline", count_col: str | None = None) -> DataFrame:
    """``docs`` with every mention replaced; ``count_col`` names a column of their number."""
    rows = materialize(mentions(docs, text_col), "mentions")
    known = surrogates(rows.where("type IS NOT NULL"), key).select(
        F.col("type").alias("t"), F.col("normal").alias("s"), "surrogate"
    )
    dressed = rows.join(
        known, (F.col("type") == F.col("t")) & (F.col("normal") == F.col("s")), "left"
    ).select(
        "text_key",
        F.struct("place", "part", _rendered(F.col("type"), F.col("part_text"), F.col("surrogate")).alias("new")).alias("row"),
    )
    # a text's own mentions come together, which its length bounds
    lists = dressed.groupBy("text_key").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    places = F.expr("array_distinct(transform(rows, r -> r.place))")
    lists = lists.select(
        F.col("text_key").alias("__pii_key"),
        F.when(
            F.exists("rows", lambda r: r.part > 0),
            F.transform(
                places,
                lambda p: F.array_join(
                    F.transform(F.filter("rows", lambda r: r.place == p), lambda r: r.new), " "
                ),
            ),
        )
        .otherwise(F.expr("transform(rows, r -> r.new)"))
        .alias("__pii_new"),
    )
    lists = materialize(lists, "replacements")
    text = docs[text_col]
    # texts that cannot hold a mention stay where they are
    may = _may_mention(text)
    joined = docs.where(may).join(lists, F.unhex(F.md5(text.cast("binary"))) == lists["__pii_key"], "left")
    fresh = F.array_join(
        F.zip_with(
            F.split(text, FIND, -1),
            F.col("__pii_new"),
            lambda piece, new: F.concat(piece, F.coalesce(new, F.lit(""))),
        ),
        "",
    )
    fresh = F.when(F.col("__pii_new").isNull(), text).otherwise(fresh)
    columns = [fresh.alias(c) if c == text_col else docs[c] for c in docs.columns]
    others = [docs[c] for c in docs.columns]
    if count_col:
        columns.append(F.coalesce(F.size("__pii_new"), F.lit(0)).cast("long").alias(count_col))
        others.append(F.lit(0).cast("long").alias(count_col))
    return joined.select(*columns).unionByName(docs.where(~may).select(*others))


__all__ = ["FIND", "PATTERNS", "mentions", "replace_pii", "surrogates"]
