"""Secret scanning: wide candidates, then a random forest that removes false positives.

Every long run of key-like characters is a candidate, wherever it stands in a word,
and so is a short one after an assignment or a key word.  The forest sees its length, how its characters change from class to class, how much of it
dictionary words cover, the path it was found under and the words around it.  It
is trained by Spark's own learner on labelled findings (a bounded table), and its
trees compile into one column expression, so scanning is a projection: no join,
no exchange, no user function.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

SPACE = r"[\x20\x09-\x0D]+"
#: Words that name a secret, and words that name something else.
KEYS = "password|passwd|pwd|secret|token|apikey|api_key|api-key|auth|credential|private"
OTHERS = "commit|sha|sha1|sha256|md5|hash|checksum|digest|uuid|guid|card|iban|order|invoice|build|version|rev|etag|isbn|serial"
#: A candidate anywhere in a word; after an assignment, a shorter one; after a key word's assignment, anything up to a mark that ends values.
LONG = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
SHORT = r"[A-Za-z0-9][A-Za-z0-9+/_\-]{3,}={0,2}"
#: (An ampersand is a part of a value, but for one that begins the next field of a query string.)
KEYED = r"(?:[^\x20\x09-\x0D\"'`<>|&,;(){}\[\]=:]|&(?![A-Za-z0-9_.\-]{0,40}=)){3,}[A-Za-z0-9+/_\-]={0,2}"
_IN_WORD = rf"(?<=[=:>][\"'`]{{0,2}})(?<=(?i:{KEYS})[A-Za-z0-9_\-]{{0,20}}[\"'`]{{0,2}}[=:>]{{1,2}}[\"'`]{{0,2}}){KEYED}|{LONG}|(?<=[=:][\"'`]{{0,2}}){SHORT}"
_FIRST = r"(?<=^[\"'`(]{0,3})"
#: Ends of the words before that make a word's first run a value.
KEY_BEFORE = rf"(?i:{KEYS})[A-Za-z0-9_\-]{{0,20}}[\"'`]{{0,2}} ?([=:]{{1,2}}>?)?$"
ASSIGNED_BEFORE = r"[=:]>?$"
#: What a word, or the word before it, must hold to be looked into.
_HOT = r"[A-Za-z0-9+/_\-]{16}|[=:>][\"'`]{0,2}[^\"'`]{4}"
_HOT_BEFORE = rf"{ASSIGNED_BEFORE}|(?i:{KEYS})[A-Za-z0-9_\-]{{0,20}}[\"'`]{{0,2}}$"
#: Parts of words that are common in identifiers and prose.
DICTIONARY = (
    "the and for that with this from have not you are was all can has one our out get set new old key val map list item name user data file path test type time date code page site link text "
    "view form node tree hash table index count value state model class field query event error index main config server client service manager handler factory builder request response message "
    "example sample demo dummy placeholder changeme document content header footer image video audio button window object string number array result report update create delete insert select"
).split()
FEATURES = ("length", "digits", "uppers", "lowers", "changes", "distinct", "hex", "only_digits", "dictionary", "key_near", "other_near", "assigned", "key_assigned", "test_path")
TREES, DEPTH, SEED = 15, 6, 11
#: Labelled findings that are made where none are given, and read at most.
FINDINGS = 4000


def _share(value: Column, kind: str) -> Column:
    return F.regexp_count(value, F.lit(kind)) / F.greatest(F.length(value), F.lit(1))


def features(value: Column, before: Column, word: Column, after: Column, path: Column) -> Column:
    """A struct of numbers; before holds the two words before, word the one the value stands in, or the part since the last value in it."""
    near = F.lower(F.concat_ws(" ", before, F.replace(word, value, F.lit(" ")), after))
    low = F.lower(value)
    # Up to the last place the value stands at.
    lead = F.concat(before, F.lit(" "), F.left(word, F.length(word) - F.length(value) - F.length(F.call_function("substring_index", word, value, F.lit(-1)))))
    covered = 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / F.greatest(F.length(low), F.lit(1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    columns = (
        F.length(value).cast("double"),
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        _share(value, "[a-z]"),
        _share(value, "[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"),
        F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
        flag(value.rlike("^[0-9a-f]+$")),
        flag(value.rlike("^[0-9]+$")),
        covered,
        flag(near.rlike(f"(^|[^a-z])({KEYS})([^a-z]|$)")),
        flag(near.rlike(f"(^|[^a-z0-9])({OTHERS})([^a-z0-9]|$)")),
        flag(lead.rlike("[=:]>? *[\"'`(]{0,3}$")),
        flag(lead.rlike(rf"(?i:{KEYS})[A-Za-z0-9_\-]{{0,20}}[\"'`]{{0,2}} *[=:>]{{1,2}} *[\"'`(]{{0,3}}$")),
        flag(F.lower(path).rlike("(^|[/_.-])(test|tests|spec|fixture|fixtures|example|examples|doc|docs|mock)([/_.-]|$)")),
    )
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(columns, FEATURES)])


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """n made findings (value, before, word, after, path, label), alike everywhere: half of them secrets.

    The path decides too: keys under tests, fixtures and examples are mostly dummies,
    which are labelled 0, while the same shapes elsewhere are labelled 1.
    """
    i = F.col("id")
    made = spark.range(0, n, 1, 4)

    def named_as(**columns: Column) -> list[Column]:
        """Columns of a step of its own: what later steps are made of is computed once, and no expression grows with all of them."""
        nonlocal made
        made = made.select("*", *[c.alias(f"_{name}") for name, c in columns.items()])
        return [F.col(f"_{name}") for name in columns]

    r = lambda k, m: F.pmod(F.xxhash64(i, F.lit(k), F.lit(seed)), F.lit(m))
    pick = lambda k, words: F.element_at(F.array(*[F.lit(w) for w in words]), (r(k, len(words)) + 1).cast("int"))
    part = lambda k: pick(k, ["ka", "tos", "ver", "al", "schaft", "ment", "en", "ique", "lor", "ado", "ing", "st", "ura", "ber", "th", "and", "er", "eux", "mi", "gre", "son"])
    h, h2 = named_as(h=F.sha2(F.concat(F.lit(f"{seed}-"), i.cast("string")), 256), h2=F.sha2(F.concat(F.lit(f"{seed}+"), i.cast("string")), 256))
    (b64,) = named_as(b64=F.regexp_replace(F.base64(F.unhex(F.concat(h, h2))), "[=\n\r]", ""))
    upper = F.upper(F.translate(F.substring(b64, 1, 60), "abcdefghijklmnopqrstuvwxyz+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ23"))
    plain = lambda k: pick(k, ["", "the", "water", "garden.", "und", "que", "of", "house,", "in", "soleil", "x1"])
    key = pick(1, ["token", "password", "secret", "api_key", "auth", "apikey", "TOKEN", "Secret"])
    other = pick(2, ["commit", "sha256", "md5", "checksum", "uuid", "hash", "build", "etag", "card", "order"])
    words = pick(3, ["getUserNameFromTable", "test_file_path_config", "index-page-example", "dataServiceManagerFactory", "sample_value_placeholder", "event_handler_request"])
    uuid = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    digits = F.substring(F.concat(F.translate(h, "abcdef", "123456"), h), 1, 16)
    letters = F.translate(F.regexp_replace(b64, "[+/]", "k"), "0123456789", "ghJkmNpqRs")
    mixed = F.regexp_replace(b64, "[+/]", "7")
    some = lambda c, least, k: F.substr(c, F.lit(3), (r(k, 8) + least).cast("int"))
    prose = F.concat(part(20), part(21), part(22))
    small = pick(28, ["from", "which", "that", "wird", "pour", "value", "there", "when", "ring", "with", "este", "para"])
    stands = pick(29, ["string", "example", "placeholder", "changeme", "value", "request.token", "user_name", "getUserName", "default", "config.value", "example_value", "user.name", "sample"])
    field = pick(30, ["region", "user", "name", "lang", "host", "type", "page", "title"])
    named = pick(31, ["us-east-1", "bobby", "alice", "localhost", "eu-west-2", "html5", "page-12", "admin", "index", "en-US1", "https", "10203"])
    dummy = pick(4, ["tests/unit/data.txt", "docs/example.md", "spec/keys.rb", "fixtures/a.json", "app/mock/auth.ts"])
    real = pick(40, ["src/app/main.py", "conf/prod.env", "web/site", "", "", "blog", "crawl/page", "dump.sql", "mail/17"])
    upper, uuid, digits, letters, mixed, prose, small = named_as(upper=upper, uuid=uuid, digits=digits, letters=letters, mixed=mixed, prose=prose, small=small)
    long_prose = F.concat(prose, pick(23, ["-", "", "_", ""]), part(24), part(25), part(26), F.lit("ation"), part(27))
    long_prose = F.when(r(39, 4) == 0, F.upper(long_prose)).when(r(39, 4) == 1, F.initcap(long_prose)).otherwise(long_prose)
    key, other, words, long_prose = named_as(key=key, other=other, words=words, long_prose=long_prose)
    # (value, what precedes it, its word, label)
    kinds = [
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain(5), "{}", 1),
        (F.substring(h, 1, 40), F.concat(key, F.lit(" =")), '"{}"', 1),
        (F.substring(h, 1, 18), plain(5), "password={}", 1),
        (F.substring(b64, 1, 40), F.concat(key, F.lit(" =")), "'{}'", 1),
        (F.substring(b64, 2, 32), F.concat(key, F.lit(":")), "{}", 1),
        (F.concat(F.lit("ghp_"), F.regexp_replace(F.substring(b64, 1, 36), "[+/]", "x")), plain(5), "{}", 1),
        (F.concat(F.lit("sk_live_"), F.regexp_replace(F.substring(b64, 1, 24), "[+/]", "q")), plain(5), "{}", 1),
        (F.substring(h, 3, 32), plain(5), "secret={}", 1),
        (F.substring(h, 1, 40), other, "{}", 0),
        (h, F.concat(other, F.lit(":")), "{}", 0),
        (uuid, other, "{}", 0),
        (digits, plain(5), "{}", 0),
        (digits, other, "{}", 0),
        (F.concat(words, r(6, 99).cast("string")), plain(5), "{}", 0),
        (F.concat(words, F.lit("_"), r(6, 9999).cast("string")), F.lit("value ="), '"{}"', 0),
        (F.concat(F.lit("/"), F.translate(words, "_", "/"), F.lit("/"), r(6, 9999).cast("string")), plain(5), "{}", 0),
        (some(mixed, 6, 32), F.concat(key, F.lit(" =")), '"{}"', 1),
        (some(mixed, 4, 32), plain(5), "password={}", 1),
        (F.concat(F.lit("q8"), some(mixed, 4, 32)), F.concat(F.lit("x "), F.lower(key)), "{}", 1),
        (F.concat(some(letters, 3, 32), F.lit("@"), F.substring(h, 1, 4)), plain(5), "pwd={}", 1),
        (F.lower(some(letters, 6, 32)), F.concat(key, F.lit(":")), "{}", 1),
        (F.substring(letters, 1, 32), F.concat(key, F.lit(" =")), "'{}'", 1),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain(5), pick(33, ['{"api_key":"', "<key>", "a=", ",b=", '","id":"', "(", "|"]), 1),
        (F.substring(h, 1, 40), plain(5), pick(34, ['{"token":"', "https://h/cb?token=", '","secret":"', "&auth=", "<password>"]), 1),
        (F.concat(F.lit("eyJ"), F.substring(mixed, 1, 34)), plain(5), pick(35, ["", ".", "token=", "("]), 1),
        (F.substring(mixed, 2, 43), F.concat(F.lit("eyJ"), F.substring(mixed, 9, 30)), ".{}", 1),
        (long_prose, plain(5), "{}", 0),
        (long_prose, pick(36, ["note:", "und", "=", "la"]), pick(37, ["", "(", "x/", '"']), 0),
        (small, F.concat(F.lit("the "), F.lower(key)), "{}", 0),
        (prose, F.concat(F.lit("the "), F.lower(key)), "{}", 0),
        (stands, F.concat(key, F.lit(" =")), '"{}"', 0),
        (named, F.concat(F.lit('{"'), F.lower(key), F.lit('":"'), F.substring(h, 1, 20)), F.concat(F.lit('","'), field, F.lit('":"')), 0),
        (named, plain(5), F.concat(field, F.lit("=")), 0),
        (prose, pick(38, ["note:", "nota:", "x =", "siehe:"]), "{}", 0),
        (F.concat(F.lit("/"), prose, F.lit("/"), r(6, 9999).cast("string"), F.lit("/"), small, F.lit("-"), part(27)), plain(5), "https://www.example.com", 0),
        (F.concat(prose, F.lit("-"), small, F.lit("-"), prose), plain(5), "{}", 0),
        # Dummies, by their path.
        (F.substring(h, 1, 40), F.concat(key, F.lit(" =")), '"{}"', None),
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain(5), "{}", None),
        (some(mixed, 6, 32), plain(5), "password={}", None),
    ]
    # A word of a kind is a form for the value, or what stands before it.
    formed = lambda k: F.concat(k[2], k[0]) if isinstance(k[2], Column) else F.format_string(k[2].replace("{}", "%s"), k[0]) if "{}" in k[2] else F.concat(F.lit(k[2]), k[0])
    # One row of its kind for each: all of a row's kinds side by side, of which one is taken.
    rows = F.array(*[F.struct(k[0].alias("value"), k[1].alias("lead"), formed(k).alias("word"), F.lit(k[3]).cast("int").alias("label")) for k in kinds])
    (row,) = named_as(kind=F.element_at(rows, (F.pmod(i, F.lit(len(kinds))) + 1).cast("int")))
    # Of rows without a label of their kind a third stand elsewhere than in dummies' places, of other false ones nine in ten, and all true ones.
    apart = F.when(F.col("f.label").isNull(), r(41, 3) == 0).otherwise((F.col("f.label") == 1) | (r(41, 10) > 0))
    made = made.select("id", row.alias("f"), plain(7).alias("first"), plain(8).alias("after")).withColumn("apart", apart)
    return made.withColumn("path", F.when(F.col("apart"), real).otherwise(dummy)).withColumn("label", F.coalesce("f.label", F.col("apart").cast("int"))).select(
        "f.value", F.concat_ws(" ", "first", "f.lead").alias("before"), "f.word", "after", "path", F.col("label").cast("double").alias("label")
    )


def _tree(lines: list[str], at: int) -> tuple[tuple, int]:
    """One node of a printed tree: (feature, threshold, yes, no) or (prediction,)."""
    line = lines[at].strip()
    if m := re.match(r"Predict: (\S+)", line):
        return (float(m[1]),), at + 1
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    yes, at = _tree(lines, at + 1)
    no, at = _tree(lines, at + 1)  # after its Else
    return (int(m[1]), float(m[2]), yes, no), at


def learn(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, limit: int = FINDINGS) -> tuple:
    """Spark's own learner fitted on labelled findings, of which at most ``limit`` are read; and its table (features, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.limit(limit).select(features(*[F.coalesce(F.col(c), F.lit("")) for c in ("value", "before", "word", "after", "path")]).alias("f"), "label").select("f.*", "label")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", maxMemoryInMB=128).fit(table), table


class Forest:
    """Trees as plain tuples, and the share of their votes as a column."""

    def __init__(self, trees: list[tuple]):
        self.trees = trees

    @classmethod
    def fit(cls, findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, limit: int = FINDINGS) -> Forest:
        """Learns from labelled findings (as labelled_findings gives them), of which at most ``limit`` are read."""
        return cls.of(learn(findings, trees, depth, seed, limit)[0])

    @classmethod
    def of(cls, model) -> Forest:
        """The trees of a fitted learner."""
        found = []
        for t in model.trees:
            lines = t.toDebugString.strip().split("\n")[1:]
            found.append(_tree(lines, 0)[0])
        return cls(found)

    def votes(self, f: Column) -> Column:
        def column(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(node[0])
            return F.when(f[FEATURES[node[0]]] <= node[1], column(node[2])).otherwise(column(node[3]))

        return reduce(lambda a, b: a + b, [column(t) for t in self.trees]) / len(self.trees)


_FOREST: dict[tuple, Forest] = {}


def forest(spark: SparkSession) -> Forest:
    """The forest of the made findings, fitted once for each session."""
    key = (spark.sparkContext.applicationId, FINDINGS, SEED)
    if key not in _FOREST:
        _FOREST[key] = Forest.fit(labelled_findings(spark))
    return _FOREST[key]


def findings(text: Column, path: Column, model: Forest) -> Column:
    """An array of (place, at, value, votes) of every candidate in a text: the word, from 0, and the character in it."""

    def runs(i: Column, words: Column) -> Column:
        """Every run of one word: what stands between the last one and it, and itself."""
        word = F.get(words, i)
        before = F.concat_ws(" ", F.when(i > 1, F.get(words, F.greatest(i - 2, F.lit(0)))), F.when(i > 0, F.get(words, F.greatest(i - 1, F.lit(0)))))
        each = lambda p: F.arrays_zip(F.regexp_extract_all(word, F.lit(f"(?s)(.*?)({p})"), F.lit(0)).alias("part"), F.regexp_extract_all(word, F.lit(f"(?s)(.*?)({p})"), F.lit(2)).alias("value"))
        parts = F.when(before.rlike(KEY_BEFORE), each(f"{_FIRST}{KEYED}|{_IN_WORD}")).when(before.rlike(ASSIGNED_BEFORE), each(f"{_IN_WORD}|{_FIRST}{SHORT}")).otherwise(each(_IN_WORD))
        next_word = F.coalesce(F.get(words, i + 1), F.lit(""))
        with_context = lambda all_: F.transform(
            all_,
            lambda p, k: F.struct(
                i.cast("long").alias("place"),
                p["value"].alias("value"),
                F.when(k > 0, F.get(all_, F.greatest(k - 1, F.lit(0)))["part"]).otherwise(before).alias("before"),
                p["part"].alias("word"),
                F.coalesce(F.get(all_, k + 1)["part"], next_word).alias("after"),
                (F.aggregate(F.slice(all_, 1, k + 1), F.lit(0), lambda n, q: n + F.length(q["part"])) - F.length(p["value"])).cast("long").alias("at"),
            ),
        )
        return F.flatten(F.transform(F.array(parts), with_context))

    def found(words: Column) -> Column:
        hot = lambda i: F.get(words, i).rlike(_HOT) | F.when(i > 0, F.get(words, F.greatest(i - 1, F.lit(0))).rlike(_HOT_BEFORE)).otherwise(False)
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), hot)
        near = F.flatten(F.transform(F.when(F.size(words) > 0, places).otherwise(F.array().cast("array<int>")), lambda i: runs(i, words)))
        seen = F.transform(F.filter(near, lambda c: c["value"].rlike("[A-Za-z0-9]")), lambda c: F.struct(c.alias("c"), features(c["value"], c["before"], c["word"], c["after"], path).alias("f")))
        return F.transform(seen, lambda s: F.struct(s["c"]["place"].alias("place"), s["c"]["at"].alias("at"), s["c"]["value"].alias("value"), F.round(model.votes(s["f"]), 6).alias("votes")))

    empty = F.array().cast("array<struct<place: bigint, at: bigint, value: string, votes: double>>")
    # Texts without a long run, an assignment or a key word go no further.
    return F.when(text.rlike(rf"[A-Za-z0-9+/_\-]{{16}}|[=:>]|(?i:{KEYS})"), F.transform(F.array(F.split(text, SPACE)), found)[0]).otherwise(empty)


def masked_text(text: Column, secrets: Column, mask: str) -> Column:
    """The text with the mask in the place of each secret; everything else, white space too, as it stands."""

    def hidden(word: Column, i: Column) -> Column:
        own = F.reverse(F.filter(secrets, lambda s: s["place"] == i))  # the last one first, so places before it hold
        put = lambda w, s: F.concat(F.left(w, s["at"].cast("int")), F.lit(mask), F.substr(w, (s["at"] + F.length(s["value"]) + 1).cast("int")))
        return F.aggregate(own, word, put)

    gaps = F.concat(F.regexp_extract_all(text, F.lit(SPACE), F.lit(0)), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.transform(F.split(text, SPACE), hidden), gaps, lambda w, g: F.concat(w, g)), "")
    return F.when(F.size(secrets) > 0, whole).otherwise(text)


def scan(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", model: Forest | None = None, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """The input with secrets (array of place, at, value, votes; candidates that the forest accepts), candidates
    (all of them) and masked (the text with each secret masked where it stands).

    Nulls: a null text has no candidates and stays null; a null path counts as
    empty.  Input columns of these names are replaced.  Repeated rows are scanned
    each, and so is a value that occurs twice in a text; the same characters
    elsewhere, which the forest does not take for a secret there, stay.  An empty
    table gives none; a text of any length is scanned whole.
    """
    model = model or forest(docs.sparkSession)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    out = docs.withColumn("candidates", findings(F.coalesce(F.col(text_col), F.lit("")), path, model))
    out = out.withColumn("secrets", F.filter("candidates", lambda c: c["votes"] >= threshold))
    return out.withColumn("masked", masked_text(F.col(text_col), F.col("secrets"), mask))


def op4(spark, sf_dir):
    docs = core.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = scan(docs).select("doc_id", F.inline("candidates"))
    return out.select("doc_id", "place", "at", "value", "votes", (F.col("votes") >= 0.5).alias("kept"))
