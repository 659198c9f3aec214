"""Turn tables and generated dialogues: context, pairs, structure checks, routing by reasons, evidence units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import features as V
from corpusloom.functions import text as X

VALID_LENGTHS = (4, 6, 8)
MIN_GROUNDING_TOKENS = 12
# What an assistant must not say.
SENSITIVE_REQUEST = r"(?i)\b(?:provide|send|share|tell me|enter|confirm)\b.{0,35}\b(?:password|pin|cvv|security code|one[- ]time code|login|full account|full card|social security|ssn)\b"
UNAVAILABLE_ACTION = r"(?i)\b(?:I|we)(?:'ll| will| can| have| am going to)\s*(?:file|submit|open|investigate|monitor|freeze|block|cancel|reverse|refund|credit|escalate|resolve|contact)\b"
RIGHTS_CLAIM = r"(?i)\byou (?:have|retain) the right to\b"
PROMISE = r"(?i)\b(?:(?:I|we|they)(?:'ll| will)|your (?:refund|credit) should)\b.{0,45}\b(?:refund|credit|reverse|resolve|complete|arrive|completed|refunded|credited|reversed|resolved)\b|\b(?:guarantee|promise|definitely|certainly)\b"


def turn_context(df: DataFrame, dialogue: str, turn: str, columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(dialogue).orderBy(turn)
    return df.withColumns({f"{side}_{c}": f(c).over(w) for c in columns for side, f in (("previous", F.lag), ("next", F.lead))})


def question_pairs(df: DataFrame, dialogue: str, turn: str, role: str, text: str, asks: str = "assistant", question: str = r"\?") -> DataFrame:
    """Turns of one role that ask, with whether a user turn follows directly."""
    w = Window.partitionBy(dialogue).orderBy(turn)
    ahead = df.select(dialogue, turn, role, text, F.lead(role).over(w).alias("next_role"), F.lead(text).over(w).alias("answer"))
    return ahead.filter((F.col(role) == asks) & F.col(text).rlike(question)).select(dialogue, turn, text, F.coalesce(F.col("next_role") == "user", F.lit(False)).alias("user_follows"), "answer")


def dialogue_summary(df: DataFrame, dialogue: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns, roles and lengths of each dialogue, its first and last role, its sequence of roles, and whether user and assistant alternate from the user on."""
    w = Window.partitionBy(dialogue).orderBy(turn)
    step = df.withColumn("before", F.lag(role).over(w))
    fits = F.when(F.col("before").isNull(), F.col(role) == "user").otherwise((F.col(role) != F.col("before")) & F.col(role).isin("user", "assistant"))
    sequence = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r")))), lambda x: x["r"]), " > ")
    return step.groupBy(dialogue).agg(
        F.count("*").alias("n_turns"),
        *[F.count(F.when(F.col(role) == r, 1)).alias(f"n_{r}") for r in ("user", "assistant", "system")],
        F.sum(F.length(text)).alias("n_chars"),
        F.min_by(role, turn).alias("first_role"),
        F.max_by(role, turn).alias("last_role"),
        F.bool_and(fits).alias("alternates"),
        sequence.alias("role_sequence"),
    )


def dialogue_features(df: DataFrame, dialogue: str, turn: str, role: str, text: str, action: Column) -> DataFrame:
    """Length bucket, action and next-step sequences of each dialogue, how many different actions it has, and how much shorter its assistant's part is than the whole.

    action: what a turn does, null for nothing; a next step is an action with the one that follows it in the dialogue.
    """
    w = Window.partitionBy(dialogue).orderBy(turn)
    acts = df.select(dialogue, turn, role, F.length(text).alias("chars"), X.count(F.col(text), r"\S+").alias("words"), action.alias("action"))
    acts = acts.withColumn("later", F.first("action", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    step = F.when(F.col("action").isNotNull() & F.col("later").isNotNull(), F.concat_ws("->", "action", "later"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(turn).alias("t"), c.alias("x"))))), lambda e: e["x"]), " > ")
    sums = acts.groupBy(dialogue).agg(
        F.sum("words").alias("n_words"),
        listed(F.col("action")).alias("action_sequence"),
        listed(step).alias("next_steps"),
        F.countDistinct("action").alias("n_actions"),
        F.try_divide(F.sum(F.when(F.col(role) == "assistant", F.col("chars")).otherwise(0)).cast("double"), F.sum("chars").cast("double")).alias("assistant_share"),
    )
    cuts = V.DIALOGUE_WORD_CUTS
    names = [f"<={cuts[0]}", *[f"{a + 1}-{b}" for a, b in zip(cuts, cuts[1:], strict=False)], f">{cuts[-1]}"]
    return sums.withColumn("length_bucket", V.band(F.col("n_words"), cuts, names))


def flow_summary(df: DataFrame, flow: str, subflow: str, action_sequence: str, n_words: str) -> DataFrame:
    """Per flow and subflow: dialogues, different action sequences, and mean length."""
    return df.groupBy(flow, subflow).agg(F.count("*").alias("n"), F.countDistinct(action_sequence).alias("sequences"), F.avg(n_words).alias("mean_words"))


def route(reasons: Column, judged: Column, decision: Column, known: Column) -> Column:
    """First of: unknown seeds are rejected; clean rows without a judgment are for review; so is what a judgment sends there, whatever the reasons; any reason, or a judgment, rejects."""
    bad = F.size(reasons) > 0
    return (
        F.when(~known, "rejected")
        .when(~judged & ~bad, "review")
        .when(judged & (decision == "review"), "review")
        .when(bad | (judged & (decision == "reject")), "rejected")
        .otherwise("validated")
    )


def dialogue_reasons(seed_id: Column, conversation: Column, expected: Column, summary: Column, notes: Column, excerpt: Column, extra: Column | None = None, forbidden: str = "") -> Column:
    """Reasons against a generated dialogue: structure, personal data, copied text, promises, thin grounding; and a judgment's own."""
    spoken = lambda c: F.array_join(F.transform(c, lambda m: m["content"]), "\n")
    generated = F.concat_ws("\n", spoken(conversation), summary, F.array_join(notes, "\n"))
    assistant = spoken(F.filter(conversation, lambda m: m["role"] == "assistant"))
    order = F.transform(conversation, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    sound = conversation.isNotNull() & F.size(conversation).isin(*VALID_LENGTHS) & F.forall(order, lambda x: x) & F.forall(conversation, lambda m: F.length(F.trim(m["content"])) > 0)
    sound = F.coalesce(sound, F.lit(False))
    grams = lambda t: X.hashed_ngrams(X.words(t), 8)
    when = lambda test, reason: F.when(F.coalesce(test, F.lit(False)), F.lit(reason))
    found = [
        when(~sound, "conversation_schema_invalid"),
        when(~sound | (F.size(conversation) != expected), "conversation_length_mismatch"),
        *[when(sound & generated.rlike(p), f"regex_pii:{n}") for n, p in V.PII_RELEASE.items()],
        when(sound & F.contains(F.lower(generated), F.lower(seed_id)), "seed_id_copied"),
        when(sound & F.contains(generated, F.lit("[PII_CANDIDATE]")), "pii_candidate_placeholder_copied"),
        when(sound & assistant.rlike(SENSITIVE_REQUEST), "assistant_sensitive_credential_request"),
        when(sound & assistant.rlike(UNAVAILABLE_ACTION), "assistant_unavailable_action_claim"),
        when(sound & assistant.rlike(RIGHTS_CLAIM), "legal_or_rights_claim"),
        when(sound & assistant.rlike(PROMISE), "assistant_outcome_or_deadline_promise"),
        when(sound & F.arrays_overlap(grams(excerpt), grams(generated)), "source_8gram_copied"),
        when(V.grounding(excerpt)["tokens"] < MIN_GROUNDING_TOKENS, "insufficient_grounding"),
    ]
    if forbidden:
        found.append(when(sound & generated.rlike(forbidden), "source_reference"))
    own = F.array_compact(F.array(*found))
    return F.array_sort(F.array_distinct(own if extra is None else F.concat(own, F.coalesce(extra, F.array().cast("array<string>")))))


def evidence_units(df: DataFrame, key: str, text: str, prefix: str = "G") -> DataFrame:
    """Sentences of a text with stable numbers such as G001."""
    units = df.select(key, F.posexplode(X.sentences(F.col(text))).alias("n", "unit_text"))
    return units.select(key, F.format_string(f"{prefix}%03d", F.col("n") + 1).alias("unit_id"), "unit_text")


def all_units(df: DataFrame, key: str, text: str, labels: dict[str, Column], strings: Sequence[Column], listed: Column) -> DataFrame:
    """Labels as L001, sentences of the text as G001, and the strings of a generated record, those of its lists after the others, as S001; empty ones are left out."""
    named = F.array(*[F.concat(F.lit(f"{n}: "), c) for n, c in labels.items()])
    said = F.concat(F.array(*strings), listed)

    def numbered(values: Column, prefix: str) -> DataFrame:
        kept = F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))
        return df.select(key, F.posexplode(kept).alias("n", "unit_text")).select(key, F.format_string(f"{prefix}%03d", F.col("n") + 1).alias("unit_id"), "unit_text")

    return numbered(named, "L").union(evidence_units(df, key, text)).union(numbered(said, "S"))


def evidence_valid(evidence: Column, source: Column) -> Column:
    """Whether a quotation stands in its source word for word."""
    return F.coalesce((F.length(evidence) > 0) & (F.instr(source, evidence) > 0), F.lit(False))


def speaker_turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, turn, speaker, words) of texts in lines `Name: words`; a line without a name goes on with the one before."""
    speaker = r"^([A-Z][A-Za-z0-9_ .'-]{0,40}):\s*(.*)$"
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line", "s")).filter(F.trim("s") != "")
    w = Window.partitionBy(key).orderBy("line")
    marked = lines.withColumns({"named": F.col("s").rlike(speaker)})
    turns = marked.withColumn("turn", F.sum(F.col("named").cast("int")).over(w))
    said = F.when(F.col("named"), F.regexp_extract("s", speaker, 2)).otherwise(F.trim("s"))
    grouped = turns.groupBy(key, "turn").agg(F.max(F.when(F.col("named"), F.regexp_extract("s", speaker, 1))).alias("speaker"), F.array_sort(F.collect_list(F.struct("line", said.alias("t")))).alias("parts"))
    return grouped.select(key, "turn", F.coalesce("speaker", F.lit("")).alias("speaker"), F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("words"))
