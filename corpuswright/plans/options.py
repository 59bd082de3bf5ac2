"""Options of the preparation plans, with the defaults of the command-line options they replace."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.denoise import DenoiseConfig


@dataclass(frozen=True)
class Options:
    """What to read, how to mix it, and how to encode it. Unset sources are left out."""

    directions: str
    # sources
    parallel_root: str | None = None
    override_test: str | None = None
    parallel_suffix: str = ""
    text_test_file: str | None = None
    instructions: str | None = None
    mono: list[str] = field(default_factory=list)
    web_mono: str | None = None
    web_langs: list[str] = field(default_factory=list)
    web_format: str = "parquet"
    web_parallel: str | None = None
    web_fallback: dict[str, str] = field(default_factory=dict)
    preferences: str | None = None
    scorer: str = "xcomet_kiwi"
    systems: tuple[str, str] = ("sys1", "sys2")
    shots: str | None = None
    # mixing
    web_probs: list[float] | None = None
    web_parallel_probs: list[float] | None = None
    seed: int = 42
    max_train: int | None = None
    max_eval: int | None = None
    max_test: int | None = None
    # encoding
    src_len: int = 256
    new_len: int = 256
    ignore_pad: bool = True
    ignore_prompt: bool = False
    right_pad: bool = False
    prefix_lm: bool = False
    chat: bool = False
    local_prompts: bool = False
    encdec: str | None = None
    # packing: ids kept of one text (None: whole texts) and rows after which a remainder is dropped (None: per source)
    max_text_tokens: int | None = None
    batch_rows: int | None = None
    # denoising of packed rows: None leaves them as they are
    denoise: DenoiseConfig | None = None
    # preference encoding
    max_length: int = 512
    max_prompt: int = 256
    truncation: str = "keep_end"
    # prepared data is kept below this folder and read again; the tag names what options cannot tell: the state of the
    # input files, and the tokenizer if it is not a `Vocabulary`
    prepared: str | None = None
    prepared_tag: str = ""
    overwrite_prepared: bool = False
