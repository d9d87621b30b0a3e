"""Questions of conversations with what they lean on: a follow-up is searched together with the questions before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CHARS = 500

# Words that point back to an earlier question, anywhere or at the beginning.
FOLLOW_UP = [
    r"(?i)\b(this|these|those|it|they|them|same|previous|earlier|above|former|latter|such)\b|\bthat (?:order|orders|rule|rules|go|document|case|circular|notification|provision|one|section|clause|policy|scheme)\b",
    r"(?i)^(and|also|but|so|then|what about|how about|what if|and if|in that case)\b",
    r"(^|\s)(इस|उस|इसी|उसी|इसके|उसके|इसमें|उसमें|इनके|उनके|इन्हें|उन्हें|इन|उन|यही|वही)(\s|$|[?,।])",
    r"(^|\s)(यह|वह|ये|वे)\s+(आदेश|नियम|शासनादेश|मामला|मामले|प्रावधान|परिपत्र|अधिसूचना|योजना)",
    r"^(और|तो|लेकिन|पर|फिर|अगर|यदि|तब)(\s|,|$)",
    r"(क्या होगा|क्या होगा अगर|इसके बारे में|उस स्थिति|उसी मामले|वही नियम)",
]


def is_follow_up(question: Column) -> Column:
    """Whether a question points back; an empty one does not."""
    out = F.lit(False)
    for pattern in FOLLOW_UP:
        out = out | F.trim(question).rlike(pattern)
    return F.coalesce(out, F.lit(False))


def compact(c: Column, most: int = MOST_CHARS) -> Column:
    """One line of at most `most` characters, a longer one marked as cut."""
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("…"))).otherwise(line)


def contextual_questions(turns: DataFrame, chosen: Column | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, turn, question, contextualized, retrieval_query) of each turn of a user: a follow-up, or one of the suggested questions (`chosen`: a condition
    on the rows), is searched with up to two questions of the user before it, in their order; empty ones do not count. A conversation is read once, in the order of its turns."""
    users = turns.where("role = 'user'").select("conv_id", "turn", F.trim(F.coalesce("text", F.lit(""))).alias("question"), (F.lit(False) if chosen is None else F.coalesce(chosen, F.lit(False))).alias("_chosen"))
    users = users.withColumn("_c", F.nullif(compact(F.col("question")), F.lit("")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    # the question before that is no empty one, and what stood before that one
    users = users.withColumn("_b", F.last("_c", ignorenulls=True).over(before))
    users = users.withColumn("_a", F.expr("lag(_c, 2) ignore nulls over (partition by conv_id order by turn)"))
    leans = F.col("_b").isNotNull() & (F.col("_chosen") | is_follow_up(F.col("question")))
    said = F.filter(F.array("_a", "_b"), lambda x: x.isNotNull())
    context = F.array_join(F.transform(said, lambda x, i: F.concat(F.lit("Previous user question "), (i + 1).cast("string"), F.lit(": "), x)), "\n")
    query = F.when(leans, F.concat(F.lit("Current question: "), "question", F.lit("\n"), context)).otherwise(F.col("question"))
    return users.select("conv_id", "turn", "question", leans.alias("contextualized"), query.alias("retrieval_query"))
