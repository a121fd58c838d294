"""Rule annotation of prompts: lines of code and prose, task, language, and the whole annotated record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import is_blank, py_strip, split_lines
from ..functions.rules import Rule, column
from .decisions import row_key
from .messages import flat, nth_user

LINE_BATCH = 20

#: What makes a line code.
CODE_STARTS = ("```", "$ ", "#!/")
CODE_MARKERS = (
    "def ", "class ", "function ", "const ", "let ", "var ", "return ", "import ", "from ", "public ", "private ", "protected ",
    "console.log", "print(", "if (", "for (", "while (", "{", "}", "</", "<div", "<span", "select ", "insert ", "update ", "delete ",
    "create table", "dockerfile", "version:", "services:", "npm ", "pip ", "git ", "traceback", "error:", "exception",
)
CODE_FILES = ("py", "js", "ts", "java", "cpp", "c", "cs", "go", "rs", "php", "html", "css", "json", "yaml", "yml", "xml", "sql")

#: Tasks in the order in which they are tried, and the words that tell each.
GREETINGS = ("hi", "hello", "thanks", "thank you", "ciao")
TASK_WORDS = (
    ("TEST_GENERATION", ("test", "unit test", "pytest", "jest", "mock")),
    ("REFACTORING", ("refactor", "cleaner", "maintainable", "optimize", "improve this code")),
    ("BUG_FIXING", ("fix", "bug", "error", "exception", "doesn't work", "not working", "wrong result")),
    ("CODE_MODIFICATION", ("modify", "update", "convert", "extend", "complete", "add support")),
    ("CONFIGURATION", ("docker", "kubernetes", "ci", "github actions", "yaml", "deployment", "environment")),
    ("DATA_QUERY", ("sql", "query", "pandas", "dataframe", "database", "csv", "data processing")),
    ("EXPLANATION", ("explain", "what is", "how does", "why does", "tutorial", "example of")),
    ("CODE_GENERATION", ("write", "create", "generate", "implement", "build", "script", "function", "class", "component", "api")),
)
TASK_HELP = ("this", "help", "please")
GENERATING = ("CODE_GENERATION", "CODE_MODIFICATION", "BUG_FIXING", "REFACTORING", "TEST_GENERATION", "CONFIGURATION", "DATA_QUERY")
TASKS = ("CODE_GENERATION", "CODE_MODIFICATION", "BUG_FIXING", "REFACTORING", "TEST_GENERATION", "EXPLANATION", "CONFIGURATION", "DATA_QUERY", "OTHER", "AMBIGUOUS")

#: Languages in the order in which they are tried, and their words.
LANGUAGE_WORDS = (
    ("IT", ("ciao", "spiegami", "scrivi", "codice", "funzione", "errore", "perché")),
    ("ES", ("hola", "explica", "escribe", "código", "función", "error", "por qué")),
    ("FR", ("bonjour", "explique", "écris", "code", "fonction", "erreur", "pourquoi")),
    ("DE", ("hallo", "erkläre", "schreibe", "funktion", "fehler", "warum")),
)
REASON = ("Fake classifier assigned ", " and detected ", ".")

_WORD = r"[\p{L}\p{N}_]"
#: Python's white space, and that part of it which JSON text doesn't escape.
_SPACE = r"[\t-\r\u001c- \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_PLAIN_SPACE = r"[ \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ASSIGNMENT = rf"{_WORD}{_SPACE}*={_SPACE}*[^\n]"
_FILE = rf"(?<!{_WORD})[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\-./]*\.({'|'.join(CODE_FILES)})(?!{_WORD})"


#: The rules of the annotation in the order in which they are tried. Python's word and space signs are spelt out for Java.
LINE_RULES = (
    Rule("EMPTY", equals=("",)),
    Rule("CODE", starts=CODE_STARTS),
    Rule("CODE", contains=CODE_MARKERS),
    Rule("CODE", matches=_ASSIGNMENT, like=r"\w+\s*=\s*.+", open_end="?"),
    Rule("CODE", matches=_FILE, like=rf"\b[\w\-./]+\.({'|'.join(CODE_FILES)})\b", lower=True),
)
TASK_RULES = (
    Rule("AMBIGUOUS", equals=("",)),
    Rule("OTHER", equals=GREETINGS),
    *(Rule(task, contains=words) for task, words in TASK_WORDS),
    Rule("BUG_FIXING", contains=TASK_HELP, only_if=True),
)
LANGUAGE_RULES = (
    Rule("UNKNOWN", equals=("",)),
    Rule("ZH", matches="[\\x{4e00}-\\x{9fff}]", like="[\u4e00-\u9fff]"),
    Rule("JA", matches="[\\x{3040}-\\x{30ff}]", like="[\u3040-\u30ff]"),
    *(Rule(lang, contains=words) for lang, words in LANGUAGE_WORDS),
)


def line_label(text: Column) -> Column:
    """EMPTY, CODE or NATURAL_LANGUAGE."""
    return column(LINE_RULES, "NATURAL_LANGUAGE", text)


def breaks_payload(text: Column) -> Column:
    """Whether a line ends the payload of its batch too early, so that the batch as a whole gets no labels."""
    return text.rlike(rf"\}}{_PLAIN_SPACE}*>>>")


def prompts(rows: DataFrame, position: str = "source_row_position", nth: int = 0) -> DataFrame:
    """(processing_key, conversation_id, source_file, row_index, user_prompt_original): the n-th user prompt, '' if none."""
    prompt = F.coalesce(nth_user(flat(F.col("conversation")), nth)["content"], F.lit(""))
    return rows.select(
        row_key(F.col("conversation_id"), F.col("source_file"), F.col(position)).alias("processing_key"),
        "conversation_id",
        "source_file",
        F.col(position).alias("row_index"),
        prompt.alias("user_prompt_original"),
    )


def line_structs(prompt: Column, batch: int = LINE_BATCH) -> Column:
    """Array of (line_number, line_text, batch_no, label, broken) of a prompt; line numbers count from 1."""
    return F.transform(
        split_lines(prompt),
        lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line_text"), F.floor(i / batch).cast("int").alias("batch_no"), line_label(x).alias("label"), breaks_payload(x).alias("broken")),
    )


def lines(asked: DataFrame, batch: int = LINE_BATCH) -> DataFrame:
    """One row per line of each prompt: (source_file, row_index, line_number, line_text, batch_no, label).

    Lines of a batch that broke are labelled EMPTY or NATURAL_LANGUAGE.
    """
    rows = _labelled(asked, batch)
    return rows.select("source_file", "row_index", F.explode("_l").alias("l")).select("source_file", "row_index", "l.line_number", "l.line_text", "l.batch_no", "l.label")


def _labelled(asked: DataFrame, batch: int) -> DataFrame:
    rows = asked.withColumn("_raw", line_structs(F.col("user_prompt_original"), batch))
    rows = rows.withColumn("_bad", F.array_distinct(F.transform(F.filter("_raw", lambda x: x["broken"]), lambda x: x["batch_no"])))
    relabelled = F.transform(
        "_raw",
        lambda x: F.struct(
            x["line_number"].alias("line_number"), x["line_text"].alias("line_text"), x["batch_no"].alias("batch_no"),
            F.when(F.array_contains(F.col("_bad"), x["batch_no"]) & (x["label"] == "CODE"), "NATURAL_LANGUAGE").otherwise(x["label"]).alias("label"),
        ),
    )
    return rows.withColumn("_l", relabelled)


def _joined(label: str) -> Column:
    return py_strip(F.array_join(F.transform(F.filter("_l", lambda x: x["label"] == label), lambda x: x["line_text"]), "\n"))


def separated(asked: DataFrame, batch: int = LINE_BATCH) -> DataFrame:
    """Prompts split into prose and code: natural_language_text, code_text, contains_code, line counts, status, error.

    All in array functions of the row: no explode, no shuffle. A blank prompt has counts of 0 and the status
    empty_prompt; a prompt with a batch that broke has partial_error.
    """
    rows = _labelled(asked, batch)
    blank = is_blank(F.col("user_prompt_original"))

    def n(label: str) -> Column:
        return F.when(blank, 0).otherwise(F.size(F.filter("_l", lambda x: x["label"] == label)))

    def missing(b: Column) -> Column:
        numbers = F.transform(F.filter("_l", lambda x: x["batch_no"] == b), lambda x: x["line_number"].cast("string"))
        return F.concat(F.lit("Missing classifications for lines: ["), F.array_join(numbers, ", "), F.lit("]"))

    failed = F.size("_bad") > 0
    errors = F.array_join(F.transform(F.array_sort("_bad"), missing), " | ")
    code = F.when(blank, "").otherwise(_joined("CODE"))
    return rows.select(
        *asked.columns,
        F.when(blank, "").otherwise(_joined("NATURAL_LANGUAGE")).alias("natural_language_text"),
        code.alias("code_text"),
        (code != "").alias("contains_code"),
        n("NATURAL_LANGUAGE").alias("natural_language_line_count"),
        n("CODE").alias("code_line_count"),
        n("EMPTY").alias("empty_line_count"),
        F.when(blank, 0).otherwise(F.size("_l")).alias("line_count"),
        F.when(blank, "empty_prompt").when(failed, "partial_error").otherwise("ok").alias("code_nl_status"),
        F.when(~blank & failed, errors).alias("code_nl_error"),
    )


def task_category(text: Column, contains_code: Column) -> Column:
    """The task that a text asks for, by the first group of words that occurs in it."""
    return column(TASK_RULES, "OTHER", text, contains_code)


def language_guess(text: Column) -> Column:
    """The language of a text, by script and then by the first group of words that occurs in it."""
    return column(LANGUAGE_RULES, "EN", text)


def task_language(rows: DataFrame) -> DataFrame:
    """Separated prompts with the seven fields of the task and language answer."""
    rows = rows.withColumns({"task_category": task_category(F.col("natural_language_text"), F.col("contains_code")), "detected_language": language_guess(F.col("natural_language_text"))})
    sure = F.when(F.col("task_category") == "AMBIGUOUS", "LOW").otherwise("HIGH")
    return rows.withColumns(
        {
            "task_confidence": sure,
            "is_code_generation": F.col("task_category").isin(*GENERATING),
            "code_generation_confidence": sure,
            "language_confidence": F.when(F.col("detected_language") == "UNKNOWN", "LOW").otherwise("HIGH"),
            "short_reason": F.concat(F.lit(REASON[0]), "task_category", F.lit(REASON[1]), "detected_language", F.lit(REASON[2])),
            "task_lang_status": F.lit("ok"),
        }
    )


RECORD = (
    "processing_key", "conversation_id", "source_file", "row_index", "user_prompt_original", "natural_language_text", "code_text", "contains_code",
    "task_category", "task_confidence", "is_code_generation", "code_generation_confidence", "detected_language", "language_confidence", "short_reason",
    "code_nl_status", "task_lang_status", "overall_status", "overall_error",
)


def annotated(rows: DataFrame, position: str = "source_row_position", nth: int = 0, batch: int = LINE_BATCH) -> DataFrame:
    """The 19 columns of the annotated record. A blank prompt's status is empty_prompt, whatever else happened."""
    out = task_language(separated(prompts(rows, position, nth), batch))
    status = F.when(F.col("code_nl_status") == "empty_prompt", "empty_prompt").when(F.col("code_nl_status") != "ok", "partial_error").otherwise("ok")
    error = F.when(~F.col("code_nl_status").isin("ok", "empty_prompt"), F.concat(F.lit("code_nl: "), "code_nl_error"))
    return out.withColumns({"overall_status": status, "overall_error": error}).select(*RECORD)

