"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 12 or more letters, digits and ``+/_-`` with a digit in
it, anywhere in a word; a value of any length and kind assigned to a secret's
name, in one word or over blanks; a password in a URL; or the header of a
private key block. Features: length, changes between character classes,
how likely its letter and digit transitions are in ordinary words, how much of
it dictionary words cover, shares of digits and capitals, distinct characters,
what its path says, and what the words around it say. The forest is trained from
labelled findings, candidates with a 0/1 label.

Where no reviewed findings are given, they are made: ``planted`` puts secrets of many
formats, and values that only look like them, between words of the documents, and
the label of a finding is what was put there. So labels come from the making and
from no feature, what stands around a finding is real text, and precision and recall
can be measured on findings that the forest has not seen (``measured``).

Dictionary and transition table are counted over all documents: the dictionary
has the words that stand in at least ``least_share`` of the texts (and in two),
so that it does not change with the number of texts; the transition table has 36
times 36 rows. Only the forest is fitted on a bounded sample, about
``labelled_rows`` findings by a hash of the row.
Candidate search reads every whole text. Only DataFrame operations and Spark's
own forest are used.

Defined results: a text that is null or has no candidate gives no row. Every
occurrence is a row, also in repeated rows. If the findings hold one class only,
every candidate gets that class; without findings, every candidate is reported
with probability 1. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import written

BLANKS = r"[\x20\x09-\x0D]+"
SECRET_NAMES = "(?i)(passw|pwd|secret|token|api|key|auth|credential)"
_RUN = "[A-Za-z0-9+/_-]"
LONG_RUN = _RUN + "{12,}+"
#: A secret's name within an identifier, and what may stand between it and its value.
_NAME = f"(?={_RUN}*{SECRET_NAMES.replace('(?i)(', '(?i:')}){_RUN}++[\"'\\\\\\])]*"
_OPEN = "[\"'\\\\(\\[]*"
_SET = "(?:[:=]+>?|%3[dD])" + _OPEN
#: Up to the closing quote; without one, up to what separates values, and not with a full stop at its end.
_VALUE = "(?:(?<=\")[^\"]+|(?<=')[^']+|[^\"'&;,<>(){}\\[\\]=:.](?:[^\"'&;,<>(){}\\[\\]]*[^\"'&;,<>(){}\\[\\].])?)"
_FIXED = rf"(://[^/:@]*:)([^/@]+)(?=@)|({LONG_RUN})"
#: Candidates of a word, and of a word whose start is assigned to a name before it.
IN_WORD = (f"({_NAME}{_SET})({_VALUE})|{_FIXED}", "$1$3\t$2$4$5\n")
AT_START = (f"({_NAME}{_SET})({_VALUE})|^([:=]*>?{_OPEN})({_VALUE})|{_FIXED}", "$1$3$5\t$2$4$6$7\n")
#: Two words, a tab and the word after them, where the name and its value are apart.
ACROSS = rf"{_NAME}(?: ?{_SET}\t|\t{_SET})"
ASSIGNED = rf"{_NAME} ?{_SET} ?{_OPEN}$"
IN_URL = "://[^/:@]*:$"
KEY_BLOCK = "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
TEST_PATHS = "(?i)(test|example|sample|fixture|mock|doc)"

#: Features of a candidate by itself and by its surroundings.
PLAIN = ["length", "class_changes", "digit_share", "capital_share", "distinct_share", "hex_only", "test_path", "named_before", "assigned", "named_after"]
FEATURES = [*PLAIN, "transition", "coverage"]


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each candidate: id, ``place`` (word number), ``value``, and what stands around it.

    Blanks cannot occur in a word, so a tab and a line end mark its candidates.
    Around a candidate stand the two words before and the next one, or the
    candidates of the same word next to it, so that a long word is read once.
    """
    words = F.split(F.col(text_col), BLANKS)
    near = lambda i, step: F.coalesce(F.get("words", i + F.lit(step)), F.lit(""))
    lead = lambda i: F.concat_ws(" ", near(i, -2), near(i, -1))
    across = lambda w, i: (near(i, -1).rlike("[:=]") | w.rlike("^[:=]")) & F.concat(lead(i), F.lit("\t"), w).rlike(ACROSS)
    header = lambda w, i: F.when(w.endswith("-----BEGIN"), F.regexp_extract(F.array_join(F.slice("words", i + 1, F.lit(6)), " "), KEY_BLOCK, 0))
    in_word = lambda w: (w.rlike("[0-9]") & w.rlike(LONG_RUN)) | (w.rlike("[:=]|%3[dD]") & w.rlike(SECRET_NAMES)) | w.rlike(_FIXED.partition("|")[0])
    hit = F.transform(
        "words",
        lambda w, i: F.when(
            in_word(w) | across(w, i) | w.endswith("-----BEGIN"),
            F.struct(i.alias("place"), w.alias("word"), lead(i).alias("lead"), near(i, 1).alias("next"), across(w, i).alias("assigned"), header(w, i).alias("header")),
        ),
    )
    marked = F.when(F.col("assigned"), F.regexp_replace("word", *map(F.lit, AT_START))).otherwise(F.regexp_replace("word", *map(F.lit, IN_WORD)))
    plain = lambda c: F.translate(c, "\n", "")
    tail = lambda p: F.substring_index(p, "\n", -1)
    each = F.transform(
        "pieces",
        lambda p, j: F.when(
            j > 0,
            F.struct(
                F.substring_index(p, "\n", 1).alias("value"),
                F.when(j == 1, F.concat("lead", F.lit(" "), F.get("pieces", F.lit(0)))).otherwise(plain(F.get("pieces", j - 1))).alias("before"),
                F.concat(tail(p), F.coalesce(plain(F.get("pieces", j + 1)), F.concat(F.lit(" "), "next"))).alias("after"),
            ),
        ),
    )
    block = F.when(F.col("header") != "", F.struct(F.col("header").alias("value"), F.col("lead").alias("before"), F.lit("").alias("after")))
    return (
        df.select(id_col, F.col(path_col).cast("string").alias("path"), F.col(text_col))
        .where(F.col(text_col).rlike("[0-9@]") | F.col(text_col).rlike(SECRET_NAMES))
        .select(id_col, "path", words.alias("words"))
        .select(id_col, "path", F.explode(F.array_compact(hit)).alias("hit"))
        .select(id_col, "path", "hit.*")
        .withColumn("pieces", F.split(marked, "\t"))
        .select(id_col, "path", "place", F.explode(F.array_compact(F.concat(each, F.array(block)))).alias("found"))
        .select(id_col, "path", "place", "found.*")
        .where((F.col("value").rlike("[0-9]") & F.col("value").rlike(f"^{LONG_RUN}$")) | F.col("before").rlike(ASSIGNED) | _in_url() | F.col("value").rlike(KEY_BLOCK))
    )


def _in_url() -> Column:
    return F.col("before").rlike(IN_URL) & F.col("after").startswith("@")


def described(found: DataFrame) -> DataFrame:
    """Adds the features that need nothing but the row."""
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / F.length("value")
    flag = lambda cond: F.coalesce(cond.cast("double"), F.lit(0.0))
    return (
        found.withColumn("length", F.length("value").cast("double"))
        .withColumn("class_changes", share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"))
        .withColumn("digit_share", share("[0-9]"))
        .withColumn("capital_share", share("[A-Z]"))
        .withColumn("distinct_share", F.size(F.array_distinct(F.split("value", ""))) / F.length("value"))
        .withColumn("hex_only", flag(F.col("value").rlike("^[0-9a-f]+$|^[0-9A-F]+$")))
        .withColumn("test_path", flag(F.col("path").rlike(TEST_PATHS)))
        .withColumn("named_before", flag(F.col("before").rlike(SECRET_NAMES)))
        .withColumn("assigned", flag(F.col("before").rlike("[=:]")))
        .withColumn("named_after", flag(F.col("after").rlike(SECRET_NAMES)))
    )


def _pairs(text: Column) -> Column:
    """Neighbouring letters and digits of a string, in lower case."""
    low = F.lower(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 1)), lambda i: F.substring(low, i, F.lit(2)))
    return F.filter(each, lambda p: p.rlike("^[a-z0-9]{2}$"))


class Classifier:
    """What is learned: transitions and dictionary from ordinary text, and the forest from labelled findings."""

    def __init__(self, transitions: DataFrame, dictionary: DataFrame) -> None:
        self.transitions, self.dictionary = transitions, dictionary
        self.model: PipelineModel | None = None
        self.constant = 1.0

    @staticmethod
    def learn_words(df: DataFrame, least_share: float, text_col: str = "text") -> Classifier:
        # Sorted, the first of equal words counts its text.
        each = F.array_sort(F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"), lambda w: w != ""))
        marked = F.transform("each", lambda w, i: F.struct(w.alias("word"), (~F.get("each", i - 1).eqNullSafe(w)).cast("long").alias("first")))
        words = df.select(each.alias("each")).select(F.explode(marked).alias("w")).groupBy("w.word").agg(F.count("*").alias("count"), F.sum("w.first").alias("texts"))
        words = written(words, "secret-words")
        pairs = words.select(F.explode(_pairs(F.col("word"))).alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("n"))
        lead = F.substring("pair", 1, 1)
        totals = pairs.groupBy(lead.alias("lead")).agg(F.sum("n").alias("all"))
        # At most 36 x 36 rows.
        likely = pairs.join(totals, lead == F.col("lead")).select("pair", F.log((F.col("n") + 0.5) / (F.col("all") + 18)).alias("logp"))
        known = words.where((F.length("word") >= 3) & (F.col("texts") >= max(2.0, least_share * df.count()))).select("word")
        return Classifier(written(likely, "secret-transitions"), written(known, "secret-dictionary"))

    def features(self, found: DataFrame) -> DataFrame:
        """Adds the learned features; ``found`` needs a unique ``row``."""
        unseen = F.lit(-6.0)
        pairs = found.select("row", F.explode(_pairs(F.col("value"))).alias("pair")).join(F.broadcast(self.transitions), "pair", "left")
        likely = pairs.groupBy("row").agg(F.avg(F.coalesce("logp", unseen)).alias("transition"))
        runs = found.select("row", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("word")).where("length(word) >= 3")
        # No broadcast hint: the dictionary is a written table, which Spark sends or shuffles by its size.
        covered = runs.join(self.dictionary, "word", "left_semi").groupBy("row").agg(F.sum(F.length("word")).alias("covered"))
        joined = described(found).join(likely, "row", "left").join(covered, "row", "left")
        return joined.withColumn("transition", F.coalesce("transition", unseen)).withColumn("coverage", F.coalesce("covered", F.lit(0)) / F.col("length")).drop("covered")

    def learn_findings(self, labelled: DataFrame, labelled_rows: int, trees: int = 20, depth: int = 6, seed: int = 11) -> Classifier:
        """``labelled``: candidates with ``row`` and ``label`` (0 or 1)."""
        kinds = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
        if len(kinds) < 2:
            self.constant = float(next(iter(kinds), 1))
            return self
        share = labelled_rows / sum(kinds.values())
        part = self.features(labelled.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)))
        part = written(part.withColumn("label", F.col("label").cast("double")), "secret-findings")
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features", cacheNodeIds=False)
        self.model = PipelineModel([assembler, forest.fit(assembler.transform(part))])
        return self

    def scored(self, found: DataFrame) -> DataFrame:
        """Adds ``probability`` that a candidate is a secret."""
        if self.model is None:
            return found.withColumn("probability", F.lit(self.constant))
        return self.model.transform(self.features(found)).withColumn("probability", vector_to_array("probability")[1])


def likely_labels(found: DataFrame) -> DataFrame:
    """Labels by rule, to compare a forest with or to review findings from.

    A value assigned to a secret's name is a finding, but not a plain word after
    a colon and a blank, as in prose; so is a URL's password, a private key
    block, and a value in a provider's key format.
    """
    named = F.col("before").rlike(ASSIGNED) & (F.col("value").rlike("[^A-Za-z]") | ~F.col("before").rlike(": $"))
    keyed = F.col("value").rlike(f"^(AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|{KEY_BLOCK})$")
    return found.withColumn("label", (named | keyed | _in_url()).cast("int"))


#: At most so many findings are made of one document.
PER_DOCUMENT = 64
#: Words that stand before and after a finding that is made.
AROUND = 6


def _kinds(h: Column, g: Column, words: Column) -> list[tuple[int, Column, Column]]:
    """(label, what is put into the text, the candidate in it) from 64 hexadecimal digits each of ``h`` and ``g``, and some ``words``."""
    hexa = lambda start, n: F.substring(h, start, n)
    digits = lambda start, n: F.translate(hexa(start, n), "abcdef", "025813")
    letters = F.translate(F.base64(F.unhex(g)), "+/=", "xY7")
    base32 = F.translate(F.upper(F.substring(g, 1, 16)), "0189", "GJKQ")
    some = lambda n: F.pmod(F.conv(hexa(50, 6), 16, 10).cast("long"), F.lit(n))
    one_of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (some(len(names)) + 1).cast("int"))
    plain = lambda i: F.lower(F.regexp_replace(F.coalesce(F.get(words, F.lit(i)), F.lit("item")), r"[^\p{L}]", ""))
    pick = lambda x: F.concat(*x)
    of_length = lambda c, least, most: F.substring(c, F.lit(1), (F.lit(least) + some(most - least + 1)).cast("int"))
    name = one_of("password", "passwd", "db_password", "secret", "client_secret", "api_key", "apikey", "token", "auth_token", "access_key")
    mixed, short, key = of_length(letters, 16, 40), F.concat(of_length(plain(0), 3, 8), digits(1, 2), F.substring(letters, 5, 2)), F.concat(F.lit("AKIA"), base32)
    lit = F.lit
    return [
        (1, pick([name, lit("="), of_length(h, 12, 40)]), of_length(h, 12, 40)),
        (1, pick([name, lit(' = "'), of_length(h, 16, 64), lit('"')]), of_length(h, 16, 64)),
        (1, pick([name, lit(": "), mixed]), mixed),
        (1, pick([lit('{"'), name, lit('":"'), mixed, lit('","region":"x"}')]), mixed),
        (1, pick([name, lit("="), short]), short),
        (1, key, key),
        (1, pick([lit("aws_access_key_id="), key]), key),
        (1, pick([lit("ghp_"), F.substring(letters, 1, 36)]), pick([lit("ghp_"), F.substring(letters, 1, 36)])),
        (1, pick([lit("postgres://app:"), mixed, lit("@db.host/x")]), mixed),
        (1, pick([lit("https://x.host/?"), name, lit("="), mixed, lit("&page=2")]), mixed),
        (1, lit("-----BEGIN RSA PRIVATE KEY-----"), lit("-----BEGIN RSA PRIVATE KEY-----")),
        (0, pick([one_of("commit", "revision", "changeset"), lit(" "), of_length(h, 12, 40)]), of_length(h, 12, 40)),
        (0, pick([one_of("sha1", "md5", "digest", "etag"), lit("="), of_length(h, 32, 64)]), of_length(h, 32, 64)),
        (0, F.concat_ws("-", hexa(1, 8), hexa(9, 4), hexa(13, 4), hexa(17, 4), hexa(21, 12)), F.concat_ws("-", hexa(1, 8), hexa(9, 4), hexa(13, 4), hexa(17, 4), hexa(21, 12))),
        (0, F.concat_ws("-", plain(0), plain(1), plain(2), digits(1, 4)), F.concat_ws("-", plain(0), plain(1), plain(2), digits(1, 4))),
        (0, F.concat_ws("_", plain(0), plain(1), plain(2), digits(1, 2)), F.concat_ws("_", plain(0), plain(1), plain(2), digits(1, 2))),
        (0, F.concat(digits(1, 10), of_length(digits(11, 10), 2, 10)), F.concat(digits(1, 10), of_length(digits(11, 10), 2, 10))),
        (0, F.concat(lit("20"), digits(1, 2), lit("-0"), digits(3, 1), lit("-1"), digits(4, 1), lit("T1"), digits(5, 1), lit(":00")), F.concat(lit("20"), digits(1, 2), lit("-0"), digits(3, 1), lit("-1"), digits(4, 1), lit("T1"), digits(5, 1))),
        (0, F.concat(lit("/"), F.concat_ws("/", plain(0), plain(1), plain(2)), digits(1, 2)), F.concat(lit("/"), F.concat_ws("/", plain(0), plain(1), plain(2)), digits(1, 2))),
        (0, pick([name, one_of("=", ": ", " = "), one_of("changeme", "none", "required", "example", "missing", "xxxxxxxx", "your_key_here")]), one_of("changeme", "none", "required", "example", "missing", "xxxxxxxx", "your_key_here")),
        (0, pick([name, one_of(": ", " = "), plain(0)]), plain(0)),
    ]


def planted(df: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", seed: int = 5) -> DataFrame:
    """About ``rows`` labelled findings: ``row``, what ``candidates`` finds of them, ``label``, and ``kind``.

    Findings are made between words of the texts that a hash chooses; the same
    number of each kind, half of a text's findings among the secrets on average.
    """
    texts = df.count()
    copies = max(1, min(PER_DOCUMENT, rows // max(1, texts)))
    key = lambda *parts: F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)
    place = lambda c: F.pmod(F.xxhash64("doc", c, F.lit(seed)), F.size("words") + 1).cast("int")
    before = lambda at: F.slice("words", F.greatest(F.lit(1), at - AROUND + 1), F.least(F.lit(AROUND), at))
    after = lambda at: F.slice("words", at + 1, F.lit(AROUND))
    each = (
        df.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) < rows / max(1, texts * copies) * (1 << 20))
        .select(F.col(id_col).cast("string").alias("doc"), F.col(path_col).alias("path"), F.split(F.coalesce(F.col(text_col), F.lit("")), BLANKS).alias("words"))
        .select("doc", "path", F.explode(F.transform(F.sequence(F.lit(1), F.lit(copies)), lambda c: F.struct(c.cast("string").alias("copy"), before(place(c)).alias("before"), after(place(c)).alias("after")))).alias("p"))
        .select("doc", "path", "p.*")
        .withColumns({"h": key("doc", "copy"), "g": key("doc", "copy", F.lit("g"))})
    )
    kinds = [F.struct(F.lit(label).alias("label"), F.lit(i).alias("kind"), text.alias("text"), value.alias("value")) for i, (label, text, value) in enumerate(_kinds(F.col("h"), F.col("g"), F.concat("after", "before")))]
    # The kind is chosen first, and only that one is made.
    each = each.withColumn("kind", F.pmod(F.xxhash64("g"), F.lit(len(kinds))).cast("int"))
    chosen = reduce(lambda chain, i: chain.when(F.col("kind") == i, kinds[i]), range(1, len(kinds)), F.when(F.col("kind") == 0, kinds[0]))
    made = each.withColumn("made", chosen)
    made = made.select(F.col("h").alias("row"), "path", F.concat_ws(" ", "before", "made.text", "after").alias("text"), "made.label", "made.kind", F.col("made.value").alias("put"))
    made = written(made, "secret-planted")
    found = candidates(made, "row", "text", "path").join(made.select("row", "label", "kind", "put"), "row").where("value = put")
    return found.dropDuplicates(["row"]).drop("put", "place")


def measured(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``n, precision, recall`` of scored findings with ``label`` and ``probability``."""
    said, true = F.col("probability") >= threshold, F.col("label") == 1
    hit = F.count_if(said & true)
    return scored.agg(F.count("*").alias("n"), F.try_divide(hit, F.count_if(said)).alias("precision"), F.try_divide(hit, F.count_if(true)).alias("recall"))


def scan(
    df: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    threshold: float = 0.5,
    labelled_rows: int = 20_000,
    least_share: float = 0.0005,
) -> DataFrame:
    """Every candidate with its features, ``probability`` and ``is_secret``.

    ``labelled``: reviewed findings (``row``, ``path``, ``value``, ``before``,
    ``after``, ``label``); without them about ``labelled_rows`` are ``planted``.
    """
    found = written(candidates(df, id_col, text_col, path_col).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    reviewed = written(planted(df, labelled_rows, id_col, text_col, path_col), "secret-labelled") if labelled is None else labelled
    model = Classifier.learn_words(df, least_share, text_col).learn_findings(reviewed, labelled_rows)
    return model.scored(found).withColumn("is_secret", F.col("probability") >= threshold)
