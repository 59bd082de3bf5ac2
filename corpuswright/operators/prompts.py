"""Prompt rendering over rows with src, tgt, src_text (and tgt_text)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.lang import local_parts, required, with_lang


@dataclass(frozen=True)
class ChatTemplate:
    """The turns of a chat tokenizer as text. The default is the [INST] form."""

    start: str = "<s>"
    user_prefix: str = "[INST] "
    user_suffix: str = " [/INST]"
    answer_prefix: str = " "
    answer_suffix: str = "</s>"
    generation: str = ""
    system_prefix: str = "<<SYS>>\n"
    system_suffix: str = "\n<</SYS>>\n\n"

    def prompt(self, user: Column) -> Column:
        """A user turn, ready for generation."""
        return F.concat(
            F.lit(self.start + self.user_prefix), user, F.lit(self.user_suffix + self.generation)
        )

    def exchange(self, user: Column, answer: Column) -> Column:
        """A user turn and the answer."""
        return F.concat(
            F.lit(self.start + self.user_prefix),
            user,
            F.lit(self.user_suffix + self.answer_prefix),
            answer,
            F.lit(self.answer_suffix),
        )

    def conversation(self, turns: Column) -> Column:
        """All turns of array<struct<role, text>> in order. A system turn stands in front of the next user turn, inside
        its marks; turns of other roles and NULL texts are left out."""

        def step(state: Column, t: Column) -> Column:
            said = F.coalesce(t["text"], F.lit(""))
            user = F.concat(state["text"], F.lit(self.start + self.user_prefix), state["system"], said, F.lit(self.user_suffix))
            answer = F.concat(state["text"], F.lit(self.answer_prefix), said, F.lit(self.answer_suffix))
            text = F.when(t["role"] == "user", user).when(t["role"] == "assistant", answer).otherwise(state["text"])
            system = (
                F.when(t["role"] == "system", F.concat(F.lit(self.system_prefix), said, F.lit(self.system_suffix)))
                .when(t["role"] == "user", F.lit("")).otherwise(state["system"])
            )
            return F.struct(text.alias("text"), system.alias("system"))

        kept = F.filter(turns, lambda t: t["text"].isNotNull())
        return F.aggregate(kept, F.struct(F.lit("").alias("text"), F.lit("").alias("system")), step, lambda s: s["text"])

    def affixes(self) -> tuple[str, str]:
        """Text before (stripped) and after (not stripped) a user sentence, special tokens left out."""
        return self.user_prefix.strip(), self.user_suffix + self.generation


def render_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate(), out: str = "chat") -> DataFrame:
    """(conv_id, turns, chat) from turn rows (conv_id, turn, role, text); a conversation is as long as its turns."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    per = turns.groupBy("conv_id").agg(ordered.alias("__t"))
    return per.select("conv_id", F.size("__t").alias("turns"), template.conversation(F.col("__t")).alias(out))


def with_names(df: DataFrame) -> DataFrame:
    """Add the English language names src_name and tgt_name."""
    return with_lang(with_lang(df, "src", "name", "src_name"), "tgt", "name", "tgt_name")


def render_prompt(df: DataFrame, out: str = "prompt") -> DataFrame:
    """Zero-shot prompt."""
    named = with_names(df)
    prompt = F.concat(
        F.lit("Translate this from "), F.col("src_name"), F.lit(" to "), F.col("tgt_name"), F.lit(":\n"),
        F.col("src_name"), F.lit(": "), F.col("src_text"), F.lit("\n"), F.col("tgt_name"), F.lit(":"),
    )
    return named.withColumn(out, prompt).drop("src_name", "tgt_name")


def render_prompt_local(df: DataFrame, out: str = "prompt") -> DataFrame:
    """Prompt in the target language; English targets keep the zero-shot form, unknown targets fail."""
    parts = local_parts(df.sparkSession).select(
        F.col("lang").alias("tgt"), F.col("prefix").alias("__pre"), F.col("suffix").alias("__suf")
    )
    joined = render_prompt(df, "__plain").join(F.broadcast(parts), "tgt", "left")
    local = F.concat(
        required(F.col("__pre"), "localized prompt", F.col("tgt")),
        F.col("src_text"),
        required(F.col("__suf"), "localized prompt", F.col("tgt")),
    )
    chosen = F.when(F.col("tgt") == "en", F.col("__plain")).otherwise(local)
    return joined.withColumn(out, chosen).drop("__plain", "__pre", "__suf")


def render_few_shot(df: DataFrame, shots: DataFrame, out: str = "prompt") -> DataFrame:
    """Header, every shot, then the query. `shots(direction, shots array<struct<source,target>>)` has one row per requested
    direction; it is written first, so that the planner knows its bytes and sends it to the rows, which do not move."""
    shots = cut_lineage(shots.select("direction", F.col("shots").alias("__shots")), "shots")
    named = with_names(df).join(shots, "direction", "left")
    src_label = F.concat(F.lit("\n"), F.col("src_name"), F.lit(": "))
    tgt_label = F.concat(F.lit("\n"), F.col("tgt_name"), F.lit(":"))
    listed = required(F.col("__shots"), "shots", F.col("direction"))
    body = F.array_join(
        F.transform(
            listed, lambda s: F.concat(src_label, s["source"], tgt_label, F.lit(" "), s["target"])
        ),
        "",
    )
    prompt = F.concat(
        F.lit("Translate this from "), F.col("src_name"), F.lit(" to "), F.col("tgt_name"), F.lit(":"),
        body, src_label, F.col("src_text"), tgt_label,
    )
    return named.withColumn(out, prompt).drop("src_name", "tgt_name", "__shots")


def render_encdec(df: DataFrame, kind: str, out: str = "prompt") -> DataFrame:
    """Encoder-decoder input: 'instruct' names the target language, 'plain' is the bare source."""
    if kind == "plain":
        return df.withColumn(out, F.col("src_text"))
    if kind == "instruct":
        named = with_lang(df, "tgt", "name", "tgt_name")
        prompt = F.concat(F.lit("Translate to "), F.col("tgt_name"), F.lit(": "), F.col("src_text"))
        return named.withColumn(out, prompt).drop("tgt_name")
    raise ValueError(f"unknown encoder-decoder kind: {kind}")


def full_text(df: DataFrame, prompt: str = "prompt", target: str = "tgt_text", out: str = "full_text") -> DataFrame:
    return df.withColumn(out, F.concat(F.col(prompt), F.col(target)))


def answer_suffix(df: DataFrame, localized: bool = False, chat_suffix: str = "", out: str = "suffix") -> DataFrame:
    """The text after which a generated output holds the answer."""
    if localized:
        parts = local_parts(df.sparkSession).select(F.col("lang").alias("tgt"), F.col("suffix").alias("__suf"))
        joined = df.join(F.broadcast(parts), "tgt", "left")
        return joined.withColumn(out, required(F.col("__suf"), "localized suffix", F.col("tgt"))).drop("__suf")
    named = with_lang(df, "tgt", "name", "tgt_name")
    suffix = F.concat(F.lit("\n"), F.col("tgt_name"), F.lit(":" + chat_suffix))
    return named.withColumn(out, suffix).drop("tgt_name")
