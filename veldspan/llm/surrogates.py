r"""Surrogates for personal data, in DataFrame functions only.

Mail addresses, IPv4 addresses, payment cards (issuer prefix and Luhn digit),
telephone numbers, IBANs (mod 97) and persons are replaced by made-up ones of the
same type and format: digits stay digits where they stood, cards and IBANs keep
valid check digits, mail goes to reserved domains, names keep gender, script and case.

A person is a capitalised name after a title, a known given name before a capitalised
one, or capitalised words that their context shows to be a name: two or three after a
cue (``name is``, ``contact``, ``signed by`` ...), or the two before a verb of saying or
a mail address in angle brackets.  Capitalised words without such a sign are left alone.

A surrogate is a keyed hash (SHA-256 of a secret, the entity and an attempt),
so one entity has one surrogate in all documents.  Distinct entities are gathered
once, pre-aggregated; in rounds, those whose surrogate is taken by another entity
or is itself an entity of the corpus try again, until none is left.  So distinct
entities stay distinct.  Names are mapped token by token, whatever the title before
them: ``Mr. Ann Lee``, ``Dr. Ann Lee`` and ``Lee`` share their surrogates.  A given
name's gender is that of the list, or else what most of its titles in the corpus say,
so it is one for all documents; names of all genders, and surnames, are kept apart
from each other.  A surname that a document has given in a person's full name is found
again where it stands alone in that document.

The secret comes from a private file of one line, which goes once surrogates are
assigned, so it isn't in any plan or event log.

Only texts with candidates are shuffled; hot entities are joined on the distinct
(row, mention) pairs, whose side adaptive execution splits.

Defined results: a null text stays null and has no entities; texts without
entities come back unchanged; invalid candidates (wrong check digits, octets
over 255) are left alone; repeated rows, ties and null keys are rows of their own;
a very long text is scanned whole; extra columns, of whatever name, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspan.workspace import Workspace, remove, write_text

KINDS = ("email", "phone", "ip", "card", "iban", "person")

# Titles by gender, and given names by gender and script.
TITLES = {
    "m": "Mr Mister Herr Herrn Señor Sr Monsieur господин г-н Κύριος".split(),
    "f": "Mrs Ms Miss Frau Señora Sra Señorita Srta Madame Mme Mademoiselle Mlle госпожа г-жа Κυρία".split(),
    "u": "Dr Mx Prof Professor Doctor Doktor доктор".split(),
}
GIVEN = {
    ("m", "latin"): "James Robert Michael William Thomas Charles Daniel Matthew Anthony Andrew Hans Klaus Jürgen Stefan Pierre François Étienne Laurent Carlos Miguel Javier Fernando Rafael Sergio".split(),
    ("f", "latin"): "Jennifer Elizabeth Barbara Susan Jessica Margaret Nicole Katherine Emily Rebecca Ursula Monika Sabine Heike Claire Nathalie Isabelle Sylvie Carmen Dolores Mercedes Beatriz Patricia Gabriela".split(),
    ("m", "cyrillic"): "Иван Сергей Дмитрий Алексей Николай Михаил Андрей Владимир".split(),
    ("f", "cyrillic"): "Анна Елена Ольга Наталья Татьяна Ирина Светлана Мария".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας".split(),
    ("f", "greek"): "Μαρία Ελένη Αικατερίνη Βασιλική".split(),
}
# What stands before a name, whatever its case, and after one; words that begin sentences rather than names.
CUES = (
    "name is ", "name: ", "contact ", "contact: ", "author: ", "written by ", "signed by ", "signed, ", "prepared by ", "reported by ", "reviewed by ",
    "dear ", "attn: ", "sincerely, ", "sincerely,\n", "regards, ", "regards,\n", "patient ", "patient: ", "customer: ", "employee: ",
    "ich heiße ", "je m'appelle ", "me llamo ", "меня зовут ", "με λένε ",
)
SAYING = ("said", "says", "told", "wrote", "writes", "asked", "replied", "added", "explained", "sagte", "schrieb", "dijo", "escribió", "a dit", "a écrit", "сказал", "сказала", "είπε")
SENTENCE_WORDS = (
    "The", "A", "An", "This", "That", "These", "Those", "He", "She", "It", "They", "We", "You", "I", "His", "Her", "Its", "Their", "Our", "My", "Your", "In", "On", "At", "For",
    "From", "With", "And", "But", "Or", "If", "When", "As", "By", "To", "Of", "Der", "Die", "Das", "Ein", "Eine", "Le", "La", "Les", "Un", "Une", "El", "Los", "Las", "Una",
)
# Consonants and vowels of made-up names, and their endings by gender.
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρσφ", "αειου")}
ENDINGS = {
    "latin": {"m": "on", "f": "a", "u": "e", "surname": "er"},
    "cyrillic": {"m": "ан", "f": "а", "u": "я", "surname": "ов"},
    "greek": {"m": "ος", "f": "α", "u": "ι", "surname": "ης"},
}

_ALL_TITLES = "|".join(t for g in TITLES.values() for t in sorted(g, key=len, reverse=True))
_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_NAME = r"\p{Lu}[\p{L}'’-]++"
_PAIR = rf"{_NAME}(?: {_NAME}){{1,2}}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63}(?![\p{L}\p{N}])"  # labels as long as the domain system allows
_IP = rf"(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)"
_CARD = r"(?<!\d[.,])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5})(?![\p{L}\p{N}])"
_PHONE = (
    r"(?:(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}|\d{3}[-.]\d{3}[-.]\d{4}"
    r"|\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,4})(?![\p{L}\p{N}]|[.-]\d)"
)
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_SAID = "|".join(SAYING)
_PERSON = (
    rf"(?:(?:{_ALL_TITLES})\.? (?:{_NAME} ){{0,2}}{_NAME}|(?:{_ALL_GIVEN})(?: {_NAME}){{1,2}}|(?<=(?iu:{'|'.join(CUES)})){_PAIR}"
    rf"|(?!(?:{'|'.join(SENTENCE_WORDS)}) ){_NAME} {_NAME}(?= (?:(?:{_SAID})(?![\p{{L}}\p{{N}}])|<[^@\s<>]{{1,64}}@)))"
)
#: Everything that may be an entity.  Repeats are bounded or possessive, so no text can exhaust the matcher.
CANDIDATE = rf"{_EMAIL}|(?<![\p{{L}}\p{{N}}])(?:(?=[\d+(])(?:{_IP}|{_CARD}|{_PHONE})|(?=[\p{{Lu}}гд])(?:{_IBAN}|{_PERSON}))"
#: The same, and capitalised words by themselves: in a text that gives persons these may be their surnames.
CANDIDATE_OR_WORD = CANDIDATE + r"|(?<![\p{L}\p{N}])(?:\p{Lu}\p{L}*+(?:['’-]\p{Lu}\p{L}*+)++|\p{Lu}\p{L}++)(?![\p{L}\p{N}])"
# issuers' prefixes at the lengths that they give out.
_ISSUER = r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d|9\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12}|6(?:011|5\d\d|4[4-9]\d)\d{12})$"
MOST_ATTEMPTS = 64


def _nibbles(i: str) -> str:
    """SQL of the i-th byte of the hash ``h``."""
    return f"CAST(conv(substr(h, 1 + 2 * CAST(({i}) % 32 AS INT), 2), 16, 10) AS INT)"


def _from(letters: str, i: str) -> str:
    return f"substr('{letters}', 1 + {_nibbles(i)} % {len(letters)}, 1)"


_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _luhn(d: str) -> str:
    """SQL of the Luhn sum of a string of digits."""
    twice = f"transform(sequence(1, greatest(1, length({d}))), i -> coalesce(try_cast(substr({d}, length({d}) - i + 1, 1) AS INT), 0) * (2 - i % 2))"
    return f"aggregate({twice}, 0, (a, x) -> a + x - CASE WHEN x > 9 THEN 9 ELSE 0 END)"


def _mod97(x: str) -> str:
    """SQL of an IBAN's remainder, its first four characters moved to the end."""
    value = f"(locate(c, '{_DIGITS}{_LOWER.upper()}') - 1)"
    chars = f"split(concat(substr({x}, 5), substr({x}, 1, 4)), '')"
    return f"aggregate({chars}, 0, (a, c) -> CASE WHEN {value} < 10 THEN a * 10 + {value} ELSE a * 100 + {value} END % 97)"


def _shape(text: str, offset: int = 0) -> str:
    """SQL: each letter or digit of a text becomes another, as the hash says."""
    i = f"i + {offset}"
    return (
        f"array_join(transform(split({text}, ''), (c, i) -> CASE WHEN c RLIKE '^[0-9]$' THEN {_from(_DIGITS, i)}"
        f" WHEN c RLIKE '^[A-Z]$' THEN {_from(_LOWER.upper(), i)} WHEN c RLIKE '^\\\\p{{L}}$' THEN {_from(_LOWER, i)} ELSE c END), '')"
    )


def _overlay(raw: str, core: str) -> str:
    """SQL: the letters and digits of ``raw`` replaced by those of ``core``, one by one."""
    step = f"named_struct('o', concat(a.o, substr({core}, a.i + 1, 1)), 'i', a.i + 1)"
    return f"aggregate(split({raw}, ''), named_struct('o', '', 'i', 0), (a, c) -> CASE WHEN c RLIKE '^[0-9A-Za-z]$' THEN {step} ELSE named_struct('o', concat(a.o, c), 'i', a.i) END, a -> a.o)"


def _made_up(script: str, role: str) -> str:
    """SQL of a made-up name; later attempts get longer ones, so there is always another."""
    hard, soft = SOUNDS[script]
    sound = f"concat({_from(hard, '2 * s')}, {_from(soft, '2 * s + 1')})"
    return f"initcap(concat(array_join(transform(sequence(1, 2 + attempt DIV 4), s -> {sound}), ''), {_from(hard, '0')}, '{ENDINGS[script][role]}'))"


def surrogate() -> Column:
    """Of ``secret, kind, norm, gender, attempt``; kinds of names are ``given:<script>`` and ``surname:<script>``."""
    when = ["CASE"]
    local, domain = "substring_index(norm, '@', 1)", "substring_index(norm, '@', -1)"
    more = "CASE WHEN attempt < 4 THEN '' ELSE CAST(attempt AS STRING) END"
    top = f"CASE WHEN substring_index({domain}, '.', -1) IN ('com', 'net', 'org') THEN substring_index({domain}, '.', -1) ELSE 'com' END"
    host = _shape(f"substring_index({domain}, '.', 1)").replace("substr(h,", "substr(hd,")
    when.append(f"WHEN kind = 'email' THEN concat({_shape(local)}, {more}, '@', {host}, '.example.', {top})")
    nanp = f"concat('1', {_from('23456789', '0')}, {_from(_DIGITS, '1')}, {_from(_DIGITS, '2')}, {_from('23456789', '3')}, {', '.join(_from(_DIGITS, str(i)) for i in range(4, 10))})"
    when.append(f"WHEN kind = 'phone' AND length(norm) = 11 AND norm LIKE '1%' THEN {nanp}")
    when.append(f"WHEN kind = 'phone' THEN concat(substr(norm, 1, 2), {_shape('substr(norm, 3)')})")
    # class E is assigned to nobody; the whole space is used only if it runs out
    octets = ", '.', ".join(_nibbles(str(i)) for i in range(1, 4))
    when.append(f"WHEN kind = 'ip' THEN concat(CASE WHEN attempt < 16 THEN 240 + {_nibbles('0')} % 15 ELSE 1 + {_nibbles('0')} % 223 END, '.', {octets})")
    stem = f"concat(substr(norm, 1, CASE WHEN norm LIKE '4%' THEN 1 ELSE 2 END), {_shape("substr(norm, CASE WHEN norm LIKE '4%' THEN 2 ELSE 3 END, length(norm) - CASE WHEN norm LIKE '4%' THEN 2 ELSE 3 END)")})"
    check = _luhn("concat(x, '0')")
    when.append(f"WHEN kind = 'card' THEN element_at(transform(array({stem}), x -> concat(x, (10 - {check} % 10) % 10)), 1)")
    bban = f"concat(substr(norm, 1, 2), '00', {_shape('substr(norm, 5)')})"
    check = f"lpad(CAST(98 - {_mod97('x')} AS STRING), 2, '0')"
    when.append(f"WHEN kind = 'iban' THEN element_at(transform(array({bban}), x -> concat(substr(x, 1, 2), {check}, substr(x, 5))), 1)")
    for script in SOUNDS:
        for g in "mfu":
            names = GIVEN["m", script] + GIVEN["f", script] if g == "u" else GIVEN[g, script]
            known = f"element_at(array({', '.join(f"'{n}'" for n in names)}), 1 + {_nibbles('0')} % {len(names)})"
            when.append(f"WHEN kind = 'given:{script}' AND gender = '{g}' THEN CASE WHEN attempt < 4 THEN {known} ELSE {_made_up(script, g)} END")
        when.append(f"WHEN kind = 'surname:{script}' THEN {_made_up(script, 'surname')}")
    sql = " ".join([*when, "END"])
    # the hash is bound once, by a lambda, as it is used many times
    own = "sha2(concat_ws('|', secret, kind, norm, attempt), 256)"
    of_domain = f"sha2(concat_ws('|', secret, 'domain', {domain}), 256)"
    return F.expr(f"element_at(transform(array(named_struct('h', {own}, 'd', {of_domain})), z -> {sql.replace('substr(hd,', 'substr(z.d,').replace('substr(h,', 'substr(z.h,')}), 1)")


def _title_gender(body: str = "raw") -> str:
    by = " ".join(f"WHEN {body} RLIKE '^(?:{'|'.join(t)})[. ]' THEN '{g}'" for g, t in TITLES.items())
    return f"CASE {by} END"


def _given_gender(token: str) -> str:
    by = " ".join(f"WHEN {token} IN ({', '.join(f"'{n}'" for s in SOUNDS for n in GIVEN[g, s])}) THEN '{g}'" for g in "mf")
    return f"CASE {by} END"


def classify(raws: DataFrame) -> DataFrame:
    """``raw, kind, pieces``: a piece is ``(kind, norm)``.  What isn't valid is left out."""
    raws = raws.select("raw", F.regexp_replace("raw", "[^0-9]", "").alias("d"), F.upper(F.replace("raw", F.lit(" "), F.lit(""))).alias("x"))

    def whole(pattern: str) -> Column:
        return F.col("raw").rlike(f"^(?:{pattern})$")

    kind = (
        F.when(F.contains("raw", F.lit("@")), "email")
        .when(whole(rf"(?:{_OCTET}\.){{3}}{_OCTET}"), "ip")
        .when(whole(_CARD), F.when(F.col("d").rlike(_ISSUER) & (F.expr(_luhn("d")) % 10 == 0), "card"))
        .when(whole(_PHONE), F.when(F.length("d").between(8, 15), "phone"))
        .when(whole(_IBAN), F.when(F.expr(_mod97("x")) == 1, "iban"))
        .when(F.col("raw").rlike(r"^\p{L}"), "person")
    )
    raws = raws.withColumn("kind", kind).where("kind IS NOT NULL")
    title = F.regexp_replace("raw", rf"^(?:{_ALL_TITLES})\.? ", "")
    raws = raws.withColumn("tokens", F.split(title, " "))
    gender = F.expr(f"coalesce({_given_gender('element_at(tokens, 1)')}, {_title_gender()}, 'u')")
    raws = raws.withColumn("gender", gender)
    phone = F.when(F.length("d") == 10, F.when(F.startswith("raw", F.lit("+")), F.col("d")).otherwise(F.concat(F.lit("1"), "d"))).otherwise(F.col("d"))
    plain = (
        F.when(F.col("kind") == "email", F.lower("raw")).when(F.col("kind") == "phone", phone).when(F.col("kind") == "card", F.col("d"))
        .when(F.col("kind") == "iban", F.col("x")).otherwise(F.col("raw"))
    )

    def piece(t: Column, i: Column) -> Column:
        script = F.when(t.rlike(r"\p{IsCyrillic}"), "cyrillic").when(t.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        last = i == F.size("tokens") - 1
        of = F.when(last, F.concat(F.lit("surname:"), script)).otherwise(F.concat(F.lit("given:"), script))
        norm = F.when(last, F.regexp_replace(F.lower(t), "(ов|ев|ёв|ин)а$", "$1")).otherwise(F.lower(t))
        return F.struct(of.alias("kind"), norm.alias("norm"))

    pieces = F.when(F.col("kind") == "person", F.transform("tokens", piece)).otherwise(F.array(F.struct(F.col("kind").alias("kind"), plain.alias("norm"))))
    return raws.select("raw", "kind", "gender", "tokens", pieces.alias("pieces"))


def assign(pieces: DataFrame, secret: str, ws: Workspace) -> DataFrame:
    """``kind, norm, sur`` for the distinct ``kind, norm`` of the pieces, whose ``gender`` is a vote for a given name's.

    Surrogates are distinct among all of one kind, and among all names, and none is an
    entity of the corpus itself.  Given names come from short lists that the corpus holds
    too; they are kept apart from other surrogates and from the corpus' surnames.
    """
    votes = F.sum(F.when(F.col("gender") == "m", 1).when(F.col("gender") == "f", -1).otherwise(0))
    space = F.when(F.contains("kind", F.lit(":")), "name").otherwise(F.col("kind"))
    pieces = pieces.groupBy("kind", "norm").agg(votes.alias("votes")).withColumn("space", space)
    pieces = pieces.withColumn("gender", F.when(F.col("votes") > 0, "m").when(F.col("votes") < 0, "f").otherwise("u")).drop("votes")
    pieces = ws.save(pieces, "pieces")
    known = pieces.where("kind NOT LIKE 'given:%'").select("space", F.lower("norm").alias("low"))
    if not secret:
        raise ValueError("surrogates need a secret")
    at = f"{ws.path}/key"
    write_text(ws.spark, at, secret, private=True)
    try:
        key = F.broadcast(ws.spark.read.text(at, wholetext=True).select(F.col("value").alias("secret")))  # one row
        return _in_rounds(pieces, known, key, ws)
    finally:
        remove(ws.spark, at)  # all rounds are written by now


def _in_rounds(pieces: DataFrame, known: DataFrame, key: DataFrame, ws: Workspace) -> DataFrame:
    pending, accepted = pieces.withColumn("attempt", F.lit(0)), None
    for k in range(MOST_ATTEMPTS):
        tried = pending.crossJoin(key).withColumn("sur", surrogate()).drop("secret").withColumn("low", F.lower("sur"))
        tried = ws.save(tried, f"tried{k}")
        free = tried.join(known, ["space", "low"], "left_anti")
        if accepted is not None:
            free = free.join(accepted, ["space", "low"], "left_anti")
        won = free.groupBy("space", "low").agg(F.min(F.struct("kind", "norm", "sur")).alias("w")).select("space", "low", "w.*")
        won = ws.save(won, f"won{k}")
        accepted = won if accepted is None else accepted.unionByName(won)
        pending = tried.join(won, ["kind", "norm"], "left_anti").select("kind", "norm", "space", "gender", (F.col("attempt") + 1).alias("attempt"))
        pending = ws.save(pending, f"pending{k}")
        if pending.isEmpty():
            return accepted.select("kind", "norm", "sur")
    raise RuntimeError(f"{MOST_ATTEMPTS} attempts left entities without a surrogate of their own")


def _formatted(raws: DataFrame, surrogates: DataFrame) -> DataFrame:
    """``raw, kind, sur``: each mention's surrogate in the mention's own format."""
    parts = raws.select("raw", F.posexplode("pieces").alias("pos", "p")).select("raw", "pos", "p.kind", "p.norm")
    parts = parts.join(surrogates, ["kind", "norm"]).groupBy("raw").agg(F.sort_array(F.collect_list(F.struct("pos", "sur"))).alias("parts"))  # a name's tokens
    out = raws.join(parts, "raw").withColumn("core", F.expr("parts[0].sur"))
    n = "length(regexp_replace(raw, '[^0-9]', ''))"

    def token(p: Column) -> Column:
        t = F.get("tokens", p["pos"])
        sur = F.when(t.rlike("(ов|ев|ёв|ин)а$") & (p["pos"] == F.size("tokens") - 1), F.concat(p["sur"], F.lit("а"))).otherwise(p["sur"])
        return F.when((F.length(t) > 1) & (F.upper(t) == t), F.upper(sur)).otherwise(sur)

    before = F.expr("substr(raw, 1, length(raw) - length(array_join(tokens, ' ')))")
    person = F.concat(before, F.array_join(F.transform("parts", token), " "))
    text = (
        F.when(F.col("kind") == "person", person)
        .when(F.col("kind") == "phone", F.expr(_overlay("raw", f"right(core, {n})")))
        .when(F.col("kind").isin("card", "iban"), F.expr(_overlay("raw", "core")))
        .when((F.col("kind") == "email") & (F.upper("raw") == F.col("raw")), F.upper("core"))
        .otherwise(F.col("core"))
    )
    return out.select("raw", "kind", text.alias("sur"))


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row, key, text, persons, found, mentions``: what the text's pattern finds, and what of it may be an entity.

    In a text that gives persons, capitalised words are found too and are mentions if they are
    a person's surname: a lookup for each word, so nothing grows with the number of persons.
    """
    none = F.array().cast("array<string>")
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    own = own.withColumn("first", F.coalesce(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), none))
    person = F.filter("first", lambda r: r.rlike(r"^[^@]*$") & r.rlike(r" \p{Lu}[^ ]{2,}$") & ~r.rlike("[0-9]"))
    surnames = F.array_distinct(F.transform(person, lambda r: F.substring_index(r, " ", -1)))
    own = own.withColumn("surnames", F.array_union(surnames, F.transform(surnames, F.upper))).withColumn("persons", F.size("surnames") > 0)
    found = F.when(F.col("persons"), F.regexp_extract_all("text", F.lit(CANDIDATE_OR_WORD), F.lit(0))).otherwise(F.col("first"))
    own = own.withColumn("found", found)
    mentions = F.when(F.col("persons"), F.array_intersect("found", F.array_union("first", "surnames"))).otherwise(F.array_distinct("found"))
    return own.select(F.monotonically_increasing_id().alias("row"), "key", "text", "persons", "found", mentions.alias("mentions"))


def pseudonymize(docs: DataFrame, secret: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_entities, n_<kind> ..., text`` of each row; ``text`` has surrogates for all entities."""
    ws = Workspace(docs.sparkSession, "surrogates")
    scanned = ws.save(_scan(docs, key, text).withColumn("some", F.size("found") > 0), "scanned", "some")
    some = scanned.where("some")
    mentions = some.select("row", F.explode("mentions").alias("raw"))
    raws = ws.save(classify(mentions.select("raw").distinct()), "raws")
    surrogates = assign(raws.select(F.explode("pieces").alias("p"), "gender").select("p.*", "gender"), secret, ws)
    formatted = ws.save(_formatted(raws, surrogates), "formatted")
    # a document's mentions come together again, with no text on the way
    known = mentions.join(formatted, "raw").groupBy("row").agg(F.collect_list(F.struct("raw", "kind", "sur")).alias("known"))
    joined = some.join(known, "row", "left")
    none = F.array().cast("array<struct<raw:string,kind:string,sur:string>>")
    joined = joined.withColumn("known", F.coalesce("known", none))
    joined = joined.withColumn("as", F.map_from_entries(F.transform("known", lambda k: F.struct(k["raw"], F.struct(k["kind"], k["sur"])))))
    joined = joined.withColumn("hits", F.transform("found", lambda r: F.try_element_at("as", r)))
    between = F.when(F.col("persons"), F.split("text", CANDIDATE_OR_WORD, -1)).otherwise(F.split("text", CANDIDATE, -1))
    filled = F.zip_with("found", "hits", lambda r, h: F.coalesce(h["sur"], r))
    whole = F.array_join(F.zip_with(between, filled, lambda b, f: F.concat(b, F.coalesce(f, F.lit("")))), "")

    def count(kind: str) -> Column:
        return F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("long").alias(f"n_{kind}")

    changed = joined.select("key", F.size(F.filter("hits", lambda h: h.isNotNull())).cast("long").alias("n_entities"), *map(count, KINDS), whole.alias("text"))
    zero = F.lit(0).cast("long")
    same = scanned.where("NOT some").select("key", zero.alias("n_entities"), *(zero.alias(f"n_{k}") for k in KINDS), "text")
    return same.unionByName(changed).withColumnRenamed("key", key)
