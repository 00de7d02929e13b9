"""Dialog normalisation: raw rows of many layouts become one message format.

A *spec* says how one layout becomes ``messages array<struct<idx, from, text, parent_idx, score>>``
and ``dataset``; specs build plain column expressions, so normalising is a projection without a
shuffle. Functions ending in ``_rows`` work on one row per message instead, for tables where a
dialog is spread over rows and may be too large for one array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import text as tx
from corpusaudit.functions import windows
from corpusaudit.session import written

MESSAGE_TYPE = "struct<idx:int,from:string,text:string,parent_idx:int,score:double>"
MESSAGES_TYPE = f"array<{MESSAGE_TYPE}>"
USER, ASSISTANT = "user", "assistant"


def _message(role: Column, body: Column, parent: Column | None, score: Column | None = None) -> Column:
    return F.struct(
        F.lit(None).cast("int").alias("idx"),
        role.alias("from"),
        body.alias("text"),
        (F.lit(None) if parent is None else parent).cast("int").alias("parent_idx"),
        (F.lit(None) if score is None else score).cast("double").alias("score"),
    )


def _numbered(messages: Column) -> Column:
    """Set ``idx`` to the position in the array."""
    return F.transform(messages, lambda m, i: m.withField("idx", i.cast("int"))).cast(MESSAGES_TYPE)


def _chained(messages: Column) -> Column:
    """Number the messages and make each one answer the message before it."""
    return F.transform(
        messages,
        lambda m, i: m.withField("idx", i.cast("int")).withField(
            "parent_idx", F.when(i > 0, (i - 1).cast("int"))
        ),
    ).cast(MESSAGES_TYPE)


def _role(value: Column, user_roles: Sequence[str], keep: Sequence[str] = ()) -> Column:
    out = F.when(F.trim(value).isin(*user_roles), F.lit(USER))
    if keep:
        out = out.when(F.trim(value).isin(*keep), F.trim(value))
    return out.otherwise(F.lit(ASSISTANT))


@dataclass(frozen=True)
class Pair:
    """One prompt and one reply. All three fields are SQL expressions over the raw row."""

    inputs: str
    targets: str
    dataset: str

    def messages(self) -> Column:
        return _numbered(
            F.array(
                _message(F.lit(USER), tx.strip(F.expr(self.inputs)), None),
                _message(F.lit(ASSISTANT), tx.strip(F.expr(self.targets)), F.lit(0)),
            )
        )


@dataclass(frozen=True)
class Turns:
    """An array of turns; each answers the one before. Roles by field, by flag or by parity."""

    array: str
    dataset: str
    body: str | None = None
    role: str | None = None
    user_roles: tuple[str, ...] = ("user", "human", "prompter")
    keep_roles: tuple[str, ...] = ("system",)
    drop_quotes: bool = False

    def messages(self) -> Column:
        def one(turn: Column, i: Column) -> Column:
            body = turn if self.body is None else turn[self.body]
            body = tx.strip(F.coalesce(body, F.lit("")))
            if self.drop_quotes:
                body = F.replace(body, F.lit('"'), F.lit(""))
            if self.role is None:
                role = F.when(i % 2 == 0, F.lit(USER)).otherwise(F.lit(ASSISTANT))
            else:
                role = _role(turn[self.role], self.user_roles, self.keep_roles)
            return _message(role, body, None)

        return _chained(F.transform(F.expr(self.array), one))


@dataclass(frozen=True)
class FlaggedTurns:
    """Two parallel arrays: the texts, and whether a person wrote each."""

    texts: str
    is_user: str
    dataset: str

    def messages(self) -> Column:
        return _chained(
            F.zip_with(
                F.expr(self.texts),
                F.expr(self.is_user),
                lambda body, human: _message(
                    F.when(human, F.lit(USER)).otherwise(F.lit(ASSISTANT)), tx.strip(body), None
                ),
            )
        )


@dataclass(frozen=True)
class Exchanges:
    """An array of (question, answer) structs, interleaved. ``preface`` goes before the first question."""

    array: str
    question: str
    answer: str
    dataset: str
    preface: str | None = None
    second_answer: str | None = None
    rating: str | None = None

    def messages(self) -> Column:
        def one(turn: Column, i: Column) -> Column:
            question = turn[self.question]
            if self.preface:
                question = F.when(i == 0, F.concat(F.expr(self.preface), question)).otherwise(question)
            parts = [
                _message(F.lit(USER), tx.strip(question), None),
                _message(
                    F.lit(ASSISTANT),
                    tx.strip(turn[self.answer]),
                    None,
                    turn[self.rating] if self.rating and not self.second_answer else None,
                ),
            ]
            if self.second_answer:
                score = turn[self.rating] if self.rating else None
                parts.append(_message(F.lit(ASSISTANT), turn[self.second_answer], None, score))
            return F.filter(F.array(*parts), lambda m: F.coalesce(m["text"], F.lit("")) != "")

        return _chained(F.flatten(F.transform(F.expr(self.array), one)))


@dataclass(frozen=True)
class Transcript:
    """A text holding several turns. ``turn_start`` is a regex in front of which the text is cut.

    A turn that matches ``user_mark`` is the user's; ``mark`` (removed from the turn) defaults to
    any speaker mark. Blank turns are dropped before numbering.
    """

    body: str
    dataset: str
    turn_start: str
    user_mark: str
    mark: str
    skip: str | None = None

    def messages(self) -> Column:
        turns = F.split(F.expr(self.body), self.turn_start)
        spoken = F.transform(
            turns,
            lambda t: _message(
                F.when(t.rlike(self.user_mark), F.lit(USER)).otherwise(F.lit(ASSISTANT)),
                tx.strip(F.regexp_replace(t, self.mark, "")),
                None,
            ),
        )
        kept = F.filter(spoken, lambda m: m["text"] != "")
        if self.skip:
            kept = F.filter(kept, lambda m: ~m["text"].rlike(self.skip))
        return _chained(kept)


@dataclass(frozen=True)
class Ranked:
    """One prompt with scored candidate replies, as (text, score) SQL expressions. Blanks are dropped."""

    prompt: str
    candidates: tuple[tuple[str, str], ...]
    dataset: str

    def messages(self) -> Column:
        replies = [
            _message(F.lit(ASSISTANT), tx.strip(F.expr(body)), F.lit(0), F.expr(score))
            for body, score in self.candidates
        ]
        kept = F.filter(F.array(*replies), lambda m: F.coalesce(m["text"], F.lit("")) != "")
        prompt = _message(F.lit(USER), tx.strip(F.expr(self.prompt)), None)
        return _numbered(F.concat(F.array(prompt), kept))


@dataclass(frozen=True)
class RankedPrompts:
    """Two prompts, each with its own scored reply."""

    prompts: tuple[str, str]
    replies: tuple[tuple[str, str], tuple[str, str]]
    dataset: str

    def messages(self) -> Column:
        asked = [_message(F.lit(USER), tx.strip(F.expr(p)), None) for p in self.prompts]
        given = [
            _message(F.lit(ASSISTANT), tx.strip(F.expr(body)), F.lit(i), F.expr(score))
            for i, (body, score) in enumerate(self.replies)
        ]
        return _numbered(F.array(*asked, *given))


@dataclass(frozen=True)
class Arena:
    """Two whole conversations with two models; assistant turns score 1 for the winner, else 0."""

    sides: tuple[tuple[str, str], ...]
    winner: str
    dataset: str

    def messages(self) -> Column:
        def side(array: str, model: str) -> Column:
            won = F.when(F.expr(model) == F.expr(self.winner), 1.0).otherwise(0.0)
            return F.transform(
                F.expr(array),
                lambda t, i: _message(
                    _role(t["role"], (USER,)),
                    t["content"],
                    F.when(i > 0, i - 1),
                    F.when(t["role"] == ASSISTANT, won),
                ),
            )

        first, second = (side(*s) for s in self.sides)
        shift = F.size(first)
        moved = F.transform(
            second, lambda m: m.withField("parent_idx", (m["parent_idx"] + shift).cast("int"))
        )
        return _numbered(F.concat(first, moved))


@dataclass(frozen=True)
class Branched:
    """Two transcripts with a common beginning: shared turns once, then a scored fork per turn."""

    chosen: str
    rejected: str
    dataset: str
    turn_start: str = r"\n\n(?=Human:|Assistant:)"
    user_mark: str = "^Human:"
    mark: str = "^(Human|Assistant):"

    def messages(self) -> Column:
        def turns(body: str) -> Column:
            return F.filter(F.split(F.expr(body), self.turn_start), lambda t: t.rlike(self.mark))

        both = F.filter(
            F.arrays_zip(turns(self.chosen).alias("a"), turns(self.rejected).alias("b")),
            lambda z: z["a"].isNotNull() & z["b"].isNotNull(),
        )
        placed = F.transform(
            both,
            lambda z, i: F.struct(
                z["a"].alias("a"),
                z["b"].alias("b"),
                # forks before this turn shift the index of the chosen message
                F.size(F.filter(F.slice(both, 1, i), lambda y: y["a"] != y["b"])).alias("forks"),
                F.when(
                    i > 0,
                    F.size(F.filter(F.slice(both, 1, i - 1), lambda y: y["a"] != y["b"])) + i - 1,
                ).alias("parent"),
            ),
        )

        def one(z: Column) -> Column:
            role = F.when(z["a"].rlike(self.user_mark), F.lit(USER)).otherwise(F.lit(ASSISTANT))
            body = [tx.strip(F.regexp_replace(z[k], self.mark, "")) for k in ("a", "b")]
            shared = F.array(
                _message(role, body[0], z["parent"], F.when(role == ASSISTANT, F.lit(1.0)))
            )
            fork = F.array(
                _message(role, body[0], z["parent"], F.lit(1.0)),
                _message(role, body[1], z["parent"], F.lit(0.0)),
            )
            return F.when(z["a"] == z["b"], shared).otherwise(fork)

        return _numbered(F.flatten(F.transform(placed, one)))


@dataclass(frozen=True)
class NumberedColumns:
    """Wide columns ``message_1 .. message_n`` of (content, role_type), empty ones skipped."""

    columns: tuple[str, ...]
    dataset: str

    def messages(self) -> Column:
        parts = [
            _message(
                F.when(F.expr(f"{c}.role_type") == "ASSISTANT", F.lit(ASSISTANT)).otherwise(F.lit(USER)),
                F.expr(f"{c}.content"),
                None,
            )
            for c in self.columns
        ]
        return _chained(F.filter(F.array(*parts), lambda m: F.coalesce(m["text"], F.lit("")) != ""))


@dataclass(frozen=True)
class Either:
    """The first spec whose condition (SQL) holds; the last branch has condition ``true``."""

    branches: tuple[tuple[str, object], ...]

    @property
    def dataset(self) -> str:
        whens = " ".join(f"when {cond} then {spec.dataset}" for cond, spec in self.branches)
        return f"case {whens} end"

    def messages(self) -> Column:
        out = None
        for cond, spec in self.branches:
            built = spec.messages()
            out = F.when(F.expr(cond), built) if out is None else out.when(F.expr(cond), built)
        return out


@dataclass(frozen=True)
class WholeTable:
    """A function of the whole table, for layouts where one dialog spans several rows."""

    transform: Callable[[DataFrame], DataFrame] = field(compare=False)


def normalise(raw: DataFrame, spec) -> DataFrame:
    """(dataset, messages) of every raw row."""
    if isinstance(spec, WholeTable):
        return raw.transform(spec.transform)
    return raw.select(F.expr(spec.dataset).alias("dataset"), spec.messages().alias("messages"))


# --- one row per message -------------------------------------------------------------------------

BLOCK = 4096


def chain_rows(
    turns: DataFrame, dialog: str, order: str, role: str, body: str, block: int = BLOCK
) -> DataFrame:
    """Number the turns of each dialog and link each to the one before."""
    narrow = turns.select(
        F.col(dialog).alias("dialog"),
        F.col(order).alias("_ord"),
        _role(F.col(role), ("user", "human", "prompter"), ("system",)).alias("from"),
        tx.strip(F.col(body)).alias("text"),
        F.lit(1).alias("_one"),
    )
    numbered = windows.running_total(
        narrow, ["dialog"], ["_ord"], F.floor(F.col("_ord") / block), "_one", "_n"
    )
    return numbered.select(
        "dialog",
        (F.col("_n") - 1).alias("idx"),
        "from",
        "text",
        F.when(F.col("_n") > 1, F.col("_n") - 2).alias("parent_idx"),
    )


def tree_rows(
    rows: DataFrame,
    tree: str,
    message: str,
    parent: str,
    order: str,
    role: str,
    body: str,
    dataset: str,
) -> DataFrame:
    """Flat rows of message trees, one message per row, with the parent as an index.

    A message is kept when it opens its tree or answers an earlier message of it. Messages without
    such a parent are dropped; a reply to a dropped message attaches to the last kept one before
    it. Trees of one message are dropped, and rows without a tree.

    The ids are written once and numbered in one ordered pass over range partitions, so a tree may be of any size and depth; parents are
    then looked up by id. The given rows are read twice: for their ids, and at the end for their texts.
    """
    ids = rows.select(
        F.col(tree).alias("dialog"),
        F.col(message).alias("_id"),
        F.col(parent).alias("_parent"),
        F.col(order).alias("_ord"),
    )
    links = written(ids.filter("dialog IS NOT NULL"), "links")
    opens = links.groupBy("dialog").agg(F.min("_ord").alias("_open"), F.count("*").alias("_size"))
    known = links.select("dialog", F.col("_id").alias("_parent"), F.col("_ord").alias("_at"))
    answers = F.coalesce(F.col("_at") < F.col("_ord"), F.lit(False))
    linked = (
        links.join(opens.filter("_size > 1"), "dialog")
        .join(known, ["dialog", "_parent"], "left")
        .select("dialog", "_id", "_parent", "_ord", "_open", ((F.col("_ord") == F.col("_open")) | answers).cast("int").alias("_one"))
    )
    numbered = windows.prefix_sum(linked, ["dialog"], [F.asc("_ord")], "_one", "_before")
    numbered = written(numbered.withColumn("idx", F.col("_before") + F.col("_one") - 1).drop("_before"), "numbered")
    places = numbered.select("dialog", F.col("_id").alias("_parent"), F.col("idx").alias("_pidx"))
    several = numbered.filter("_one = 1 AND idx > 0").select("dialog").distinct()
    placed = (
        numbered.filter("_one = 1")
        .join(places, ["dialog", "_parent"], "left")
        .join(several, "dialog", "left_semi")
        .select(
            "dialog",
            "_ord",
            "idx",
            F.when(F.col("_ord") > F.col("_open"), F.col("_pidx")).alias("parent_idx"),
        )
    )
    # everything above works on ids; the texts are shuffled once, here
    texts = rows.select(
        F.col(tree).alias("dialog"),
        F.col(order).alias("_ord"),
        _role(F.col(role), ("user", "prompter"), ()).alias("from"),
        F.replace(tx.strip(F.col(body)), F.lit('"'), F.lit("")).alias("text"),
        F.col(dataset).alias("dataset"),
    )
    return texts.join(placed, ["dialog", "_ord"]).select(
        "dataset", "dialog", "idx", "from", "text", "parent_idx"
    )


def records_between_blanks(
    lines: DataFrame, file: str, number: str, body: str, block: int = BLOCK
) -> DataFrame:
    """Lines of files cut into records at blank lines: (file, record, text)."""
    marked = lines.select(
        F.col(file).alias("file"),
        F.col(number).alias("_no"),
        F.col(body).alias("_line"),
        (tx.strip(F.col(body)) == "").cast("int").alias("_blank"),
    )
    cut = windows.running_total(
        marked, ["file"], ["_no"], F.floor(F.col("_no") / block), "_blank", "record"
    )
    return (
        cut.filter("_blank = 0")
        .groupBy("file", "record")
        .agg(F.array_sort(F.collect_list(F.struct("_no", "_line"))).alias("_lines"))
        .select("file", "record", F.array_join(F.col("_lines._line"), "\n").alias("text"))
    )


def story_pairs(records: DataFrame, dataset: str, mark: str = "\nStory: ") -> DataFrame:
    """Records of prompt lines and a marked story become two-message dialogs."""
    parts = F.split("text", mark)
    inputs = F.concat(F.get(parts, F.lit(0)), F.lit(mark))
    targets = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "\n")
    return records.select(
        F.lit(dataset).alias("dataset"),
        "file",
        "record",
        tx.strip(inputs).alias("inputs"),
        tx.strip(targets).alias("targets"),
    )


def merge_speaker_runs(
    turns: DataFrame, dialog: str, order: str, role: str, body: str, sep: str = "\n", block: int = BLOCK
) -> DataFrame:
    """Join consecutive turns of one speaker: (dialog, run, round, from, text).

    ``run`` counts speaker changes, ``round`` counts user turns, so the rows of one round are a user
    turn and all that follows it.
    """
    base = turns.select(
        F.col(dialog).alias("dialog"),
        F.col(order).alias("_ord"),
        F.col(role).alias("from"),
        F.col(body).alias("_body"),
    )
    cut = F.floor(F.col("_ord") / block)
    changes = windows.previous_row(base, ["dialog"], ["_ord"], cut, {"_before": "from"}).withColumn(
        "_new", (~F.col("from").eqNullSafe(F.col("_before"))).cast("int")
    )
    runs = windows.running_total(changes, ["dialog"], ["_ord"], cut, "_new", "run")
    merged = (
        runs.groupBy("dialog", "run", "from")
        .agg(F.array_sort(F.collect_list(F.struct("_ord", "_body"))).alias("_parts"))
        .withColumn("text", F.array_join(F.col("_parts._body"), sep))
        .withColumn("_user", (F.col("from") == USER).cast("int"))
    )
    return windows.running_total(
        merged, ["dialog"], ["run"], F.floor(F.col("run") / block), "_user", "round"
    ).select("dialog", "run", "round", "from", "text")


def fold_rows(messages: DataFrame, dataset: Column | None = None) -> DataFrame:
    """One row per dialog from one row per message (a dialog must fit into one row).

    Without ``dataset`` the first message's column of that name counts.
    """
    packed = F.struct(
        F.col("idx").cast("int").alias("idx"),
        F.col("from"),
        F.col("text"),
        F.col("parent_idx").cast("int").alias("parent_idx"),
        F.lit(None).cast("double").alias("score"),
    )
    return (
        messages.groupBy("dialog")
        .agg(
            F.array_sort(F.collect_list(packed)).alias("messages"),
            *([F.min_by("dataset", "idx").alias("dataset")] if dataset is None else []),
        )
        .select("dialog", "dataset" if dataset is None else dataset.alias("dataset"), "messages")
    )


def unfold(dialogs: DataFrame, keep: Sequence[str] = ("dataset",)) -> DataFrame:
    return dialogs.select(*keep, F.inline("messages"))


# --- use of normalised dialogs -------------------------------------------------------------------


def supervised_pairs(dialogs: DataFrame, keep: Sequence[str] = ("dataset",)) -> DataFrame:
    """(inputs, targets) of every assistant message that answers a user message.

    A score, when present, must be at least 1. A message counts only if its chain of parents ends
    in a root.
    """
    messages = F.col("messages")
    grounded = F.aggregate(
        messages,
        F.array().cast("array<boolean>"),
        lambda seen, m: F.array_append(
            seen,
            m["parent_idx"].isNull()
            | ((m["parent_idx"] < m["idx"]) & F.coalesce(F.get(seen, m["parent_idx"]), F.lit(False))),
        ),
    )
    with_flags = dialogs.withColumn("_grounded", grounded)
    replies = F.filter(
        messages,
        lambda m: (m["from"] == ASSISTANT)
        & F.coalesce(F.get(messages, m["parent_idx"])["from"] == USER, F.lit(False))
        & (m["score"].isNull() | (m["score"] >= 1))
        & F.get(F.col("_grounded"), m["idx"]),
    )
    pairs = F.transform(
        replies,
        lambda m: F.struct(
            m["idx"].alias("idx"),
            F.get(messages, m["parent_idx"])["text"].alias("inputs"),
            m["text"].alias("targets"),
        ),
    )
    return with_flags.select(*keep, F.inline(pairs))


def supervised_pairs_rows(messages: DataFrame) -> DataFrame:
    """The same on one row per message of a chained dialog: an equi self-join on the parent index."""
    asked = messages.filter(F.col("from") == USER).select(
        "dialog", F.col("idx").alias("parent_idx"), F.col("text").alias("inputs")
    )
    answers = messages.filter(F.col("from") == ASSISTANT).select(
        "dialog", "idx", "parent_idx", F.col("text").alias("targets")
    )
    return answers.join(asked, ["dialog", "parent_idx"]).drop("parent_idx")


def sample_dialogs(
    dialogs: DataFrame, per: list[str], key: Column, n: int, seed: int = 0
) -> DataFrame:
    """At most ``n`` random rows of each group, the same ones on every run.

    The order is a digest of seed and key; Spark keeps only the first ``n`` per group in each task
    before the shuffle.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return windows.first_n_per_key(
        dialogs.withColumn("_draw", draw), per, [F.asc("_draw")], n
    ).drop("_draw")


def dialog_counts(messages: DataFrame, dialog: str = "dialog") -> DataFrame:
    return messages.groupBy(dialog).count().agg(
        F.count("*").alias("dialogs"), F.sum("count").alias("messages")
    )


def text_metrics(messages: DataFrame, dataset: str = "dataset", include_system: bool = True) -> DataFrame:
    """Dialog counts, turn and length statistics per dataset. Non-user messages count as targets.

    Aggregates per dialog first, so that turn counts and lengths come from one pass.
    """
    if not include_system:
        messages = messages.filter(F.col("from") != "system")
    asked = F.col("from") == USER
    size = F.length("text")
    per_dialog = messages.groupBy(dataset, "dialog").agg(
        F.count("*").alias("turns"),
        *[
            f(F.when(cond, size)).alias(f"{f.__name__}_{side}")
            for side, cond in (("inputs", asked), ("targets", ~asked))
            for f in (F.count, F.sum, F.min, F.max)
        ],
    )
    sides = ("inputs", "targets")
    return per_dialog.groupBy(dataset).agg(
        F.count("*").alias("num_dialogs"),
        *[F.round(F.sum(f"sum_{s}") / F.sum(f"count_{s}"), 4).alias(f"mean_{s}_length") for s in sides],
        *[F.max(f"max_{s}").cast("bigint").alias(f"max_{s}_length") for s in sides],
        *[F.min(f"min_{s}").cast("bigint").alias(f"min_{s}_length") for s in sides],
        F.min("turns").alias("min_dialog_turns"),
        F.max("turns").alias("max_dialog_turns"),
        F.round(F.sum("turns") / F.count("*"), 4).alias("mean_dialog_turns"),
    )


def keep_filter_ids(rows: DataFrame, column: str, accepted: DataFrame) -> DataFrame:
    """Rows whose filter id is accepted (``accepted`` has one column of the same name)."""
    return rows.join(accepted.select(column).distinct(), column, "left_semi")


def tagged_union(sources: dict[str, DataFrame], accepted: Sequence[str] | None = None) -> DataFrame:
    """Union of the sub-sources whose id is accepted, each tagged in ``_source``."""
    chosen = {k: df for k, df in sources.items() if accepted is None or k in accepted}
    if not chosen:
        raise ValueError("none of the sub-sources is accepted")
    out = None
    for name, df in chosen.items():
        tagged = df.withColumn("_source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def filter_id_map(catalog: DataFrame) -> DataFrame:
    """(collection, uid, filter_id), one row per accepted id."""
    return catalog.select("collection", "uid", F.explode("filter_ids").alias("filter_id"))


def root_to_uid(dialogs: DataFrame, ids: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replace the filter id in ``dataset`` by the dataset uid.

    Returns the dialogs with a known id and the unknown ids with their counts; ``strict`` makes an
    unknown id an error when the result is computed.
    """
    lookup = ids.select(F.col("filter_id").alias("dataset"), "uid")
    joined = dialogs.join(lookup, "dataset", "left")
    unknown = (
        joined.filter(F.col("uid").isNull())
        .groupBy(F.col("dataset").alias("filter_id"))
        .agg(F.count("*").alias("dialogs"))
    )
    if strict:
        uid = F.coalesce(
            F.col("uid"),
            F.raise_error(F.concat(F.lit("unknown filter id: "), F.col("dataset"))).cast("string"),
        )
        return joined.withColumn("dataset", uid).drop("uid"), unknown
    known = joined.filter(F.col("uid").isNotNull())
    return known.withColumn("dataset", F.col("uid")).drop("uid"), unknown


def question_rows(articles: DataFrame, entries: str, questions: str, answers: str) -> DataFrame:
    """Articles with lists of entries, each with parallel question/answer lists: one row per question."""
    exploded = articles.withColumn("_entry", F.explode(entries))
    pairs = F.arrays_zip(
        F.col("_entry")[questions].alias("question"), F.col("_entry")[answers].alias("answer")
    )
    return exploded.select(*[c for c in articles.columns if c != entries], F.inline(pairs))


def json_rounds(rows: DataFrame, column: str) -> DataFrame:
    """Conversations stored as JSON text: ``{round_0: {response: "{Q, A}"}, ...}``, rounds in order of number.

    Adds ``conversations array<struct<question, answer>>``. A row where any question or answer is
    not a text is rejected, as is a row without rounds.
    """
    rounds = F.map_entries(F.from_json(column, "map<string,struct<response:string>>"))
    named = F.filter(rounds, lambda e: e["key"].rlike("^round_[0-9]+$") & e["value"]["response"].isNotNull())
    number = lambda e: F.substring(e["key"], 7, 38).cast("decimal(38,0)")
    numbered = F.array_sort(F.transform(named, lambda e: F.struct(number(e).alias("i"), e["value"]["response"].alias("r"))))
    present = F.transform(numbered, lambda e: e["r"])

    def kind(response: Column, name: str) -> Column:
        part = F.try_variant_get(F.try_parse_json(response), f"$.{name}", "variant")
        return F.schema_of_variant(part)

    texts = F.forall(
        present,
        lambda r: F.coalesce((kind(r, "Q") == "STRING") & (kind(r, "A") == "STRING"), F.lit(False)),
    )
    turns = F.transform(
        present,
        lambda r: F.struct(
            F.get_json_object(r, "$.Q").alias("question"), F.get_json_object(r, "$.A").alias("answer")
        ),
    )
    return rows.filter((F.size(present) > 0) & texts).withColumn("conversations", turns)


def instruction_of(code: Column) -> Column:
    """Instruction of an API record: its first line, or the quoted field of a record written inline."""
    body = tx.strip(code)
    quoted = F.regexp_extract(body, "'Instruction': (.*), 'Output'", 1)
    head = F.replace(tx.first_line(body), F.lit("###Instruction: "), F.lit(""))
    picked = F.when(body.startswith("###"), head).otherwise(quoted)
    return tx.strip(F.regexp_replace(picked, "^'+|'+$", ""))


def recode(target: Column, source: Column, values: dict[str, str]) -> Column:
    """Replace ``target`` where ``source`` has one of the given values."""
    out = None
    for key, value in values.items():
        out = F.when(source == key, F.lit(value)) if out is None else out.when(source == key, F.lit(value))
    return target if out is None else out.otherwise(target)


