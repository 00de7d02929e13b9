"""Collection presets: how each public collection is selected and normalised.

``select`` tells how accepted ids narrow a source: ``all`` rows, a ``filter`` on one column, ``tag``
(sub-sources tagged in ``_source``) or ``per id`` (one file or folder per id). Specs are SQL
expressions over the raw row, see :mod:`corpusaudit.operators.dialogs`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.operators import dialogs as dg
from corpusaudit.operators.dialogs import (
    Arena,
    Branched,
    Either,
    Exchanges,
    FlaggedTurns,
    NumberedColumns,
    Pair,
    Ranked,
    RankedPrompts,
    Transcript,
    Turns,
    WholeTable,
)


@dataclass(frozen=True)
class Preset:
    spec: object
    select: str = "all"
    column: str | None = None


def by(column: str, spec) -> Preset:
    return Preset(spec, "filter", column)


def tag(spec) -> Preset:
    return Preset(spec, "tag", "_source")


def per_id(spec) -> Preset:
    return Preset(spec, "per id", "_source")


# Instruction texts that are part of the published prompts.
SUMMARIZE_ARTICLE = "\\n\\n\\nSummarize the above article:"
SUMMARIZE_TEXT = "\\n\\n\\nSummarize the above text:"
EXPLAIN_JOKE = "\\n\\nExplain this joke."
MASK_PERSONAL = (
    "\\n\\nGiven the previous paragraph, please mask any personally identifiable information using"
    " masks, such as [FIRSTNAME_1], [AGE_2], [GENDER_1], or [COUNTRY_2],.."
)
RATE_PROMPT = (
    "\\n\\nConsidering the previous paragraph, rate the quality of its content on a scale of 1 to 5."
    " Here are the criteria to consider: \\n Grammar and mechanics: Are there any grammatical errors,"
    " typos, or punctuation mistakes? (1 = Many errors, 5 = Flawless) \\n Clarity: Is the paragraph"
    " easy to understand? Is the writing clear and concise? (1 = Difficult to understand, 5 = Crystal"
    " clear) \\n Specificity of information: Does the paragraph provide specific details and examples"
    " to support its claims? (1 = Very vague, 5 = Highly specific) \\n Organization: Does the paragraph"
    " flow logically and smoothly from sentence to sentence? (1 = Disorganized, 5 = Well-organized)"
)
TABLE_CREATED = "Here is how the SQL table was created:\\n\\n"
COMPLETE_FRAME = (
    "Following the examples and complete the structured explanation for the given statement.\\n\\n"
)
# Labels of the statement frames; the first four give the context.
FRAME_CONTEXT = [
    ("speakerIdentity", "Speaker identity/characteristics"),
    ("listenerIdentity", "Listener identity/characteristics"),
    ("statementCheck", "The statement is complete and understandable"),
    ("relevantPowerDynamics", "Relevant power dynamics"),
]
FRAME_ANSWER = [
    ("conversationContext", "Conversational context"),
    ("statement", "Statement"),
    ("intent", "Intent"),
    ("offensiveness", "Offensiveness"),
    ("targetGroup", "Targeted/referenced minority group"),
    ("implication", "Implied meaning/stereotype"),
    ("targetGroupEmotionalReaction", "Targeted minority group emotional reaction"),
    ("targetGroupCognitiveReaction", "Targeted minority group cognitive reaction"),
]

# SQL templates that several collections share.
SPACE_JOINED = "concat_ws(' ', instruction, input)"
LINE_JOINED = "concat_ws('\\n', instruction, input)"
INPUT_BELOW = "concat(trim(instruction), if(coalesce(input, '') = '', '', concat('\\n', trim(input))))"
RUN_ON = "concat(instruction, input)"
CITATION = "'\\\\s*\\\\[.*?\\\\]\\\\s*'"
CONTEXT_FIRST = f"regexp_replace(trim(concat_ws('\\n', context, instruction)), {CITATION}, '')"
RESPONSE_CLEAN = f"regexp_replace(response, {CITATION}, '')"


def frames(fields: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"concat('[{label}] ', {name}, '[/]')" for name, label in fields)
    return f"concat_ws('\\n', {parts})"


def flan(label: str = "task_name") -> Preset:
    return by("task_name", Pair("inputs", "targets", label))


def chat(array: str, dataset: str, role: str = "role", body: str = "content", **more) -> Turns:
    return Turns(array, dataset, body=body, role=role, **more)


def human_chat(array: str, dataset: str) -> Turns:
    return chat(array, dataset, role="from", body="value", user_roles=("human",), keep_roles=())


def instruct(dataset: str, inputs: str = RUN_ON, targets: str = "output") -> Pair:
    return Pair(inputs, targets, dataset)


def _open_assistant(rows: DataFrame) -> DataFrame:
    flat = dg.tree_rows(
        rows, "message_tree_id", "message_id", "parent_id", "ord", "role", "text", "lang"
    )
    return dg.fold_rows(flat).select("dataset", "messages")


def _tiny_stories(lines: DataFrame) -> DataFrame:
    pairs = dg.story_pairs(dg.records_between_blanks(lines, "file", "line_no", "text"), "tiny-stories")
    return dg.normalise(pairs, Pair("inputs", "targets", "dataset"))


TREE = Preset(WholeTable(_open_assistant), "filter", "lang")
OIG_TURNS = Transcript(
    "case when trim(text) like 'Background:%' then concat('<human>: ',"
    " regexp_replace(trim(text), '^(?s)(.*?)<human>: ', '$1\\n')) else trim(text) end",
    "_source",
    turn_start="(?=<human>:|<bot>:|Rosey:)",
    user_mark="^<human>",
    mark="<human>:|<bot>:|Rosey:",
)
BAIZE_TURNS = Transcript(
    "input",
    "_source",
    turn_start=r"(?=\[\|Human\|\]|\[\|AI\|\])",
    user_mark=r"^\[\|Human\|\]",
    mark=r"^\[\|(Human|AI)\|\]",
    skip=r"^The conversation between human and AI assistant\.$",
)
NECTAR = Either(
    (
        ("turns = 1", Pair("split_part(prompt, 'Assistant:', 1)", "answers[0].answer", "'nectar'")),
        (
            "true",
            Transcript(
                "concat(rtrim(prompt), ' ', answers[0].answer)",
                "'nectar'",
                turn_start="(?=Human: |Assistant:)",
                user_mark="^Human:",
                mark="^(Human: |Assistant:)",
            ),
        ),
    )
)
CAMEL = Either(
    (
        (
            "_source <> 'code' and _source not like '%ai-society-translated%'",
            Pair("message_1.content", "message_2.content", "_source"),
        ),
        ("num_messages = 0", Pair("specified_task", "termination_reason", "_source")),
        ("true", NumberedColumns(tuple(f"message_{i}" for i in range(1, 41)), "_source")),
    )
)
INDIC = Either(
    (
        ("dataset = 'dolly'", Pair(CONTEXT_FIRST, RESPONSE_CLEAN, "dataset")),
        ("dataset = 'flan_v2'", Pair("inputs", "targets", "dataset")),
        ("dataset = 'nmt-seed'", Pair("input_text", "output_text", "dataset")),
        (
            "dataset = 'wikihow'",
            Pair(
                "concat(intro, array_join(transform(steps, s -> concat('\\n', s.description)), ''),"
                " messages[0].content)",
                "messages[1].content",
                "dataset",
            ),
        ),
        ("true", chat("messages", "dataset")),
    )
)
ULTRACHAT = Either(
    (
        ("_source = 'UltraChat'", Turns("data", "'ultrachat'")),
        ("true", chat("messages", "'ultrachat_200k'")),
    )
)
SELFEE_OUTPUT = (
    "array_join(transform(outputs, (o, i) -> concat("
    "if(i = 0, o.output, concat('\\n\\n### Revision ', i, ':\\n', o.output)),"
    " '\\n\\n### Feedback ', i + 1, ':\\n', o.feedback)), '')"
)
OPTIONS = (
    "concat(trim(question), '\\n', array_join(transform(arrays_zip(choices.label, choices.text),"
    " c -> concat(c.label, ': ', c.text, ', ')), ''))"
)
QUOTE = "coalesce(concat(trim({0}.extract[0]), '\\n\\n\\n'), '')"
HC3 = Ranked("question", (("human_answers[0]", "1"), ("chatgpt_answers[0]", "0")), "source")
ARENA = Arena(
    (("conversation_a", "model_a"), ("conversation_b", "model_b")),
    "winner",
    "'chatbot_arena_conversations'",
)

PRESETS: dict[str, Preset] = {
    "Open-Platypus": by(
        "data_source", Pair("concat_ws(' ', input, instruction)", "output", "data_source")
    ),
    "Flan Collection (Super-NaturalInstructions)": flan(),
    "Flan Collection (Chain-of-Thought)": flan(),
    "Flan Collection (Dialog)": flan(),
    "Flan Collection (Flan 2021)": flan(),
    "Flan Collection (P3)": flan(),
    "Dolly 15k": by("category", Pair(CONTEXT_FIRST, RESPONSE_CLEAN, "category")),
    "xP3x": per_id(
        Pair(
            "inputs",
            "targets",
            "concat(language, '/', if(dataset = 'clue', config, element_at(split(dataset, '/'), -1)))",
        )
    ),
    "CommitPackFT": per_id(
        Pair(
            "concat(old_contents, '\\n\\n', subject)",
            "new_contents",
            "lower(translate(lang, ' \\'()', '-'))",
        )
    ),
    "Anthropic HH-RLHF": Preset(Branched("chosen", "rejected", "'anthropic_hhrlhf'")),
    "Self-Instruct": Preset(Pair("prompt", "completion", "'self_instruct'")),
    "Capybara": by("source", Exchanges("conversation", "input", "output", "source")),
    "Stanford Human Preferences": by(
        "domain",
        Ranked("history", (("human_ref_A", "score_A"), ("human_ref_B", "score_B")), "domain"),
    ),
    "Open Assistant": TREE,
    "Open Assistant v2": TREE,
    "Open Assistant OctoPack": Preset(
        chat("conversations", "'octopack'", body="text", user_roles=("prompter",), keep_roles=(), drop_quotes=True)
    ),
    "Indic-Instruct": per_id(INDIC),
    "OpenAI (Summarize from Feedback)": Preset(
        Ranked(
            f"concat(trim(info.post), '{SUMMARIZE_ARTICLE}')",
            (("summaries[0].text", "abs(choice - 1)"), ("summaries[1].text", "choice")),
            "'openai-summarize'",
        )
    ),
    "OpenAI (WebGPT)": by(
        "dataset",
        RankedPrompts(
            (
                f"concat({QUOTE.format('quotes_0')}, trim(question.full_text))",
                f"concat({QUOTE.format('quotes_1')}, trim(question.full_text))",
            ),
            (("answer_0", "score_0"), ("answer_1", "score_1")),
            "dataset",
        ),
    ),
    "Longform": by("source", Pair("input", "output", "source")),
    "GPTeacher": tag(Pair(INPUT_BELOW, "response", "_source")),
    "Alpaca": Preset(instruct("'alpaca'", SPACE_JOINED)),
    "Glaive Code Assistant": Preset(Pair("question", "answer", "'glaive_code_assistant'")),
    "Glaive Code Assistant v2": Preset(Pair("question", "answer", "'glaive-code-assistant-v2'")),
    "Glaive Code Assistant v3": Preset(Pair("question", "answer", "'glaive-code-assistant-v3'")),
    "Nectar": Preset(NECTAR),
    "MetaMathQA": by("type", Pair("query", "response", "type")),
    "RiddleSense": Preset(Pair(OPTIONS, "answerKey", "'riddle_sense'")),
    "EverythingLM": Preset(instruct("'everything_lm'", SPACE_JOINED)),
    "GPT-4-Alpaca": Preset(instruct("'gpt4alpaca'", INPUT_BELOW)),
    "lmsys_chat_1m": Preset(chat("conversation", "'lmsys_chat_1m'")),
    "WizardLM Evol-Instruct": Preset(
        Pair("conversations[0].value", "conversations[1].value", "'evol_instruct'")
    ),
    "WizardLM Evol-Instruct V2": Preset(
        Pair("conversations[0].value", "conversations[1].value", "'evol_instruct_v2'")
    ),
    "Pure-Dove": Preset(Exchanges("conversation", "input", "output", "'pure_dove'")),
    "Feedback Collection": Preset(Pair("instruction", "output", "'feedback_collection'")),
    "Preference Collection": Preset(Pair("instruction", "output", "'preference_collection'")),
    "MagPie-Pro": Preset(human_chat("conversations", "'magpie'")),
    "Synthetic-GSM8K-Reflection": Preset(
        Pair("question", "answer", "'synthetic_gsm8k_reflection'")
    ),
    "Llama2-MedTuned-Instructions": Preset(
        instruct("'llama2_med_tuned_instructions'", LINE_JOINED)
    ),
    "OIG": tag(OIG_TURNS),
    "Thai Gen AI (Alpaca)": Preset(instruct("'thai_gen_ai_alpaca'", INPUT_BELOW)),
    "SEACrowd": by("user_parent", Pair("question", "answer", "user_parent")),
    "ShareGPT Vicuna": Preset(human_chat("conversations", "'sharegpt_vicuna'")),
    "Code Alpaca": Preset(instruct("'code_alpaca'", INPUT_BELOW)),
    "HC3 (English)": by("source", HC3),
    "HC3 (Chinese)": by("source", HC3),
    "Camel-AI Science": tag(CAMEL),
    "CoT Collection": tag(Pair("source", "rationale", "_source")),
    "NomicAI GPT4AllJ": by("source", Pair("prompt", "response", "source")),
    "Unnatural Instructions": Preset(
        Pair(
            "instances.instruction_with_input[0]", "instances.output[0]", "'unnatural_instructions'"
        )
    ),
    "StarCoder Self-Instruct": Preset(Pair("instruction", "output", "'starcoder-self-instruct'")),
    "Thai Gen AI (GPTeacher)": Preset(instruct("'thai_gen_ai_gpteacher'", INPUT_BELOW)),
    "Tiny Stories": Preset(WholeTable(_tiny_stories)),
    "Thai Gen AI (Dolly)": by(
        "category",
        Pair("concat_ws('\\n', nullif(context, ''), instruction)", "response", "category"),
    ),
    "Tasksource Instruct": by("task", Pair("inputs", "targets", "task")),
    "Tasksource Symbol-Tuning": by("task", Pair("inputs", "targets", "task")),
    "Stack Exchange Instruction": Preset(
        Pair("question", "response", "'stack-exchange-instruction'")
    ),
    "Joke Explanation": Preset(
        Pair(f"concat(joke, '{EXPLAIN_JOKE}')", "explaination", "'joke-explanation'")
    ),
    "Book Summaries": by(
        "type", Pair(f"concat(trim(input), '{SUMMARIZE_TEXT}')", "output", "'summary'")
    ),
    "UltraChat": tag(ULTRACHAT),
    "UltraChat_200k": tag(ULTRACHAT),
    "Airoboros": Preset(human_chat("conversations", "'airoboros'")),
    "LIMA": by("source", Turns("conversations", "source")),
    "MathInstruct": tag(Pair("instruction", "output", "_source")),
    "Tool-Llama": Preset(Pair("concat(context, instruction)", "response", "'toolbench'")),
    "Gorilla": Preset(Pair("instruction", "response", "'gorilla-apibench'")),
    "Baize Chat Data": tag(BAIZE_TURNS),
    "PMC-LLaMA Instructions": by("source", Pair(RUN_ON, "output", "source")),
    "Medical Meadow": tag(Pair(RUN_ON, "output", "_source")),
    "MedInstruct": Preset(instruct("'medinstruct'")),
    "Open Orca": by("source", Pair("concat(system_prompt, question)", "response", "source")),
    "ToxicChat": per_id(
        Ranked("user_input", (("model_output", "1 - toxicity"),), "'toxicchat0124'")
    ),
    "COIG": per_id(
        Exchanges("conversations", "question", "answer", "source", preface="instruction")
    ),
    "COIG-CQIA": tag(Pair(RUN_ON, "output", "_source")),
    "SelFee": Preset(Pair("instruction", SELFEE_OUTPUT, "'selfee'")),
    "SeaBench": by("lang", Pair("turns[0]", "coalesce(chatgpt_response, '')", "lang")),
    "Deita 10K": by("source", human_chat("conversations", "source")),
    "ChatDoctor": tag(Pair("input", "output", "_source")),
    "AgentInstruct": per_id(human_chat("conversations", "split_part(id, '_', 1)")),
    "Cidar": Preset(Pair("instruction", "output", "'cidar'")),
    "PII-Masking-200k": Preset(
        Pair(f"concat(source_text, '{MASK_PERSONAL}')", "target_text", "'pii-masking-200k'")
    ),
    "No Robots": by("category", Pair("messages[0].content", "messages[1].content", "category")),
    "HelpSteer": Preset(Pair("prompt", "response", "'HelpSteer'")),
    "Bactrian-X": tag(Pair("concat(instruction, ' ', coalesce(input, ''))", "output", "_source")),
    "WildChat": by("model", chat("conversation", "model")),
    "PygmalionAI-PIPPA": Preset(
        FlaggedTurns("conversation.message", "conversation.is_human", "'PygmalionAI-PIPPA'")
    ),
    "CollectiveCognition": Preset(human_chat("conversations", "'CC-chats-data-2023-10-16'")),
    "ChatbotArena": Preset(ARENA),
    "KIWI": Preset(
        Exchanges(
            "interaction",
            "instruction",
            "answer_1",
            "'KIWI'",
            second_answer="answer_2",
            rating="rating",
        )
    ),
    "Orca-Math": Preset(Pair("question", "answer", "'orca-math'")),
    "Cobra Frames": tag(
        Pair(
            f"concat('{COMPLETE_FRAME}', examples, '\\n', {frames(FRAME_CONTEXT)})",
            frames(FRAME_ANSWER),
            "_source",
        )
    ),
    "MathDial": Preset(
        Transcript(
            "conversation",
            "'mathdial'",
            turn_start=r"\|EOM\|",
            user_mark="^(?!\\s*Teacher:)",
            mark="^[^:]*:",
        )
    ),
    "10k Prompt Ranked": Preset(
        Pair(
            f"concat(prompt, '{RATE_PROMPT}')",
            "concat('The rating for the above paragraph is ', avg_rating, '.')",
            "'10k-prompt-ranked'",
        )
    ),
    "Aya Dataset": by(
        "language_code",
        Pair(
            "inputs",
            "targets",
            "if(language = 'Simplified Chinese', 'zhs', language_code)",
        ),
    ),
    "MegaWika": per_id(Pair("input", "output", "source")),
    "Gretel Text-to-SQL": Preset(
        Pair(
            f"concat('{TABLE_CREATED}', sql_context, '\\n\\n', sql_prompt)",
            "sql",
            "'gretel_text_to_sql'",
        )
    ),
    "ExpertQA": Preset(Pair("question", "answer", "'expert_qa'")),
    "OpenMathInstruct-1": by("dataset", Pair("question", "generated_solution", "dataset")),
    "OpenGPT Healthcare": tag(
        Transcript(
            "text",
            "_source",
            turn_start=r"<\|eos\|>",
            user_mark=r"^\s*<\|user\|>",
            mark="^[^>]*>",
        )
    ),
    "Conifer": Preset(chat("messages", "'conifer'", keep_roles=())),
    "Reasoning": Preset(
        Pair("instruction", "concat_ws('\\n', reasoning, output)", "'reasoning-0.01'")
    ),
    "DialogStudio": tag(Exchanges("log", "user utterance", "system response", "_source")),
    "UltraFeedback Argilla": by("source", Pair("instruction", "chosen_response", "source")),
    "LongAlign-10k": Preset(chat("messages", "'LongAlign-10k'")),
    "Dynosaur": by(
        "taskname",
        Pair("concat(trim(instruction), ' The task input is ', input, '.')", "output", "taskname"),
    ),
    "Lumos Planning": by("dataset", chat("messages", "dataset")),
    "Lumos Grounding": by("dataset", chat("messages", "dataset")),
    "InstAr": by("source", Pair("instruction", "output", "source")),
}


def normalise_collection(name: str, raw: DataFrame) -> DataFrame:
    """(dataset, messages) of a collection's raw rows."""
    return dg.normalise(raw, PRESETS[name].spec)
