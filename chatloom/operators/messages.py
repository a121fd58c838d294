"""Messages of nested conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import is_blank, py_strip


def flat(conversation: Column) -> Column:
    """All messages in order; null turns are passed over, null messages keep their position."""
    return F.flatten(F.filter(conversation, lambda t: t.isNotNull()))


def role_is(role: Column, name: str) -> Column:
    """The role, stripped and in lower case, equals ``name``; null does not."""
    return F.coalesce(F.lower(py_strip(role)) == name, F.lit(False))


def users(msgs: Column) -> Column:
    """The user messages of a flat message array."""
    return F.filter(msgs, lambda m: role_is(m["role"], "user"))


def nth_user(msgs: Column, n: int = 0) -> Column:
    """The n-th user message (0-based) as a struct, null beyond the last or for a negative n."""
    return F.get(users(msgs), F.lit(n)) if n >= 0 else F.get(users(msgs), F.lit(2**30))


def first_user_prompt(conversation: Column) -> Column:
    """Content of the first user message, '' where there is none."""
    return F.coalesce(nth_user(flat(conversation))["content"], F.lit(""))


def messages(raw: DataFrame, *keep: str) -> DataFrame:
    """One row per message: ``keep`` columns of the record, then msg_pos, role, content, language.

    Records without messages give no rows; columns of ``raw`` with the names of message fields do not clash.
    """
    return raw.select(*keep, F.posexplode(flat(F.col("conversation"))).alias("msg_pos", "m")).select(
        *keep, "msg_pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"), F.col("m.language").alias("language")
    )


def lenient_text(m: Column) -> Column:
    """Text of a message in the exploratory policy: stripped content; where that is null, role and language joined."""
    other = F.concat(F.coalesce(py_strip(m["role"]), F.lit("")), F.coalesce(py_strip(m["language"]), F.lit("")))
    return F.coalesce(py_strip(m["content"]), other)


def lenient_role(m: Column) -> Column:
    """Role in the exploratory policy: a null role reads as the word none."""
    return F.coalesce(F.lower(py_strip(m["role"])), F.lit("none"))


#: Substrings that make a role a user's or an assistant's in the exploratory policy.
USER_ROLES = "user|human|developer"
ASSISTANT_ROLES = "assistant|gpt|chatgpt|llm|model"


def structure_flags(msgs: Column) -> dict[str, Column]:
    """Flags of a conversation's shape: has_messages, has_user, has_assistant, has_user_text, has_assistant_text, structurally_valid."""
    user = F.filter(msgs, lambda m: lenient_role(m).rlike(USER_ROLES))
    bot = F.filter(msgs, lambda m: lenient_role(m).rlike(ASSISTANT_ROLES))
    some = F.coalesce(F.size(msgs) > 0, F.lit(False))
    user_text = F.coalesce(F.exists(user, lambda m: ~is_blank(lenient_text(m))), F.lit(False))
    bot_text = F.coalesce(F.exists(bot, lambda m: ~is_blank(lenient_text(m))), F.lit(False))
    return {
        "has_messages": some,
        "has_user": F.coalesce(F.size(user) > 0, F.lit(False)),
        "has_assistant": F.coalesce(F.size(bot) > 0, F.lit(False)),
        "has_user_text": user_text,
        "has_assistant_text": bot_text,
        "structurally_valid": some & user_text & bot_text,
    }
