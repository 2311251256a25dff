"""Prompts, providers and notes: everything around a call to a text model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import markdown as M
from folio.functions import repair
from folio.functions import text as T
from folio.schemas import NOTES

# Wording of the prompts.
GLOSSARY_HEAD = "### واژه‌نامه تخصصی (Glossary) که باید رعایت شود:"
CONTEXT_HEAD = "### بافت و زمینه صفحات قبلی:"
SOURCE_LABEL, TARGET_LABEL = "زبان مبدأ: ", "زبان مقصد: "
SOURCE_HEAD = "متن ورودی جهت ترجمه:"
CLOSING = "ترجمه نهایی (فقط متن ترجمه شده را با همان ساختار دقیق مارک‌داون، حفظ کامل تگ‌های تصاویر و حفظ ۱۰۰٪ دست‌نخورده کدهای درون ``` خروجی دهید. بدون هیچ‌گونه مقدمه، نتیجه‌گیری یا توضیحات اضافی):"
BOUNDARY_HEAD = "Adjacent Page Boundary Context:"
BEFORE, AFTER = ("- Previous page ends with: '... ", "'"), ("- Next page starts with: '", " ...'")
BOUNDARY_RULE = "Rule: If a sentence is split across page boundaries, ensure the translation maintains natural Persian fluency without leaving meaningless incomplete fragments. Translate ONLY the current page's content."
CODE_RULE = (
    "قانون حیاتی برای بلوک‌های کد:\n"
    "تگ‌های [[CODE_BLOCK_0]]، [[CODE_BLOCK_1]] و غیره جایگاه بلوک‌های کد برنامه‌نویسی هستند. این تگ‌ها را دقیقاً با همان فرمت و بدون هیچ‌گونه ترجمه، تغییر، جا‌به‌جایی یا حذف، در همان موقعیت میان پاراگراف‌ها قرار دهید."
)
IMAGE_RULE = (
    "قانون حیاتی برای تصاویر، نمودارها و دیاگرام‌ها:\n"
    "تگ‌های [[IMAGE_BLOCK_0]]، [[IMAGE_BLOCK_1]] و غیره جایگاه تصاویر، دیاگرام‌ها و نمودارهای صفحه هستند. این تگ‌ها را دقیقاً با همان فرمت و بدون هیچ‌گونه ترجمه، تغییر، جا‌به‌جایی یا حذف، دقیقاً در همان موقعیت میان پاراگراف‌ها یا بالای عناوین شکل‌ها حفظ کنید."
)
INSTRUCTIONS = "Additional Instructions: "
HISTORY_HEAD = "تاریخچه گفتگوی قبلی در این صفحه:"
FOLLOW_UP_HEAD = "تاریخچه گفتگوی قبلی در این صفحه (پاسخ باید در ادامه گفتگوی قبلی باشد):"
QUOTED_SELECTION = r'(?:\n|^)[^\n]*?(?:متن مورد سوال|کد یا متن مورد سوال)[^\n]*?\n*"""\s*\{selected_text\}\s*"""\n*'
NOTES_ONLY = "دستورالعمل خروجی: مستقیماً فقط نوت‌های مفهومی، عمیق و تخصصی این بخش را بنویسید. بدون هیچ‌گونه مقدمه، احوالپرسی یا تعارف."
STRICT = "دستور اکید: هیچ‌گونه جمله هماهنگی، سلام، تعارف یا تأییدیه ننویسید. بلافاصله و مستقیماً فقط خود نوت‌های استخراج‌شده این بخش را ارسال نمایید:"
MOCK_PREFIX, MOCK_SUFFIX = "ترجمه روان: ", " (ترجمه)"
PASSED_THROUGH = "INSTANT_PASSTHROUGH (Code/Media Only)"
PERSIAN_NAMES = ("persian", "farsi", "فارسی")
NO_TEXT = "array<struct<source_term:string,target_term:string,both:boolean>>"


def glossary_section(terms: Column) -> Column:
    """Rules of a glossary (array of source_term, target_term, both), one per line; null without any."""
    line = lambda g: F.concat(
        F.lit("- '"), g["source_term"], F.lit("' → '"), g["target_term"], F.lit("'"), F.when(g["both"], F.concat(F.lit(" (در صورت لزوم با ذکر انگلیسی در پرانتز: "), g["target_term"], F.lit(" ("), g["source_term"], F.lit("))"))).otherwise("")
    )
    return F.when(F.size(terms) > 0, F.concat(F.lit(f"{GLOSSARY_HEAD}\n"), F.array_join(F.transform(terms, line), "\n")))


def context_notes(before: Column, after: Column, has_code: Column, has_images: Column, instructions: Column | None = None) -> Column:
    """What a model is told besides the text: the ends of the neighbouring pages, rules for tokens where there are any, further instructions; '' if nothing."""
    ends = F.concat_ws("\n", *(F.when(T.filled(x).isNotNull(), F.concat(F.lit(a), x, F.lit(b))) for x, (a, b) in ((before, BEFORE), (after, AFTER))))
    boundary = F.when(ends != "", F.concat(F.lit(f"{BOUNDARY_HEAD}\n"), ends, F.lit(f"\n{BOUNDARY_RULE}"))).otherwise("")
    rules = [F.when(has_code, f"\n\n{CODE_RULE}").otherwise(""), F.when(has_images, f"\n\n{IMAGE_RULE}").otherwise("")]
    more = [F.when(T.filled(instructions).isNotNull(), F.concat(F.lit(f"\n\n{INSTRUCTIONS}"), instructions)).otherwise("")] if instructions is not None else []
    return F.concat(boundary, *rules, *more)


def translation_prompt(source: Column, source_language: Column, target_language: Column, system: Column, terms: Column | None = None, context: Column | None = None) -> Column:
    """The request for a translation: system text, languages, glossary, context, the source between tags, and what is wanted; without a system text the source alone. Null counts as ''."""
    head, body = (T.unix_lines(F.coalesce(x, F.lit(""))) for x in (system, source))
    none = F.lit(None).cast("string")
    opened = lambda x: F.coalesce(F.concat(F.lit("\n\n"), x), F.lit(""))
    around = T.filled(context) if context is not None else none
    section = opened(glossary_section(terms) if terms is not None else none)
    notes = opened(F.concat(F.lit(f"{CONTEXT_HEAD}\n"), T.unix_lines(around)))
    languages = (F.coalesce(x, F.lit("")) for x in (source_language, target_language))
    first, second = languages
    parts = (head, F.lit(f"\n\n{SOURCE_LABEL}"), first, F.lit(f"\n{TARGET_LABEL}"), second, F.lit("\n"), section, F.lit("\n"), notes, F.lit(f"\n\n{SOURCE_HEAD}\n<source_document>\n"), body, F.lit(f"\n</source_document>\n\n{CLOSING}\n"))
    return F.when(head == "", body).otherwise(F.concat(*parts))


def filled_template(template: Column, values: list[tuple[str, Column]]) -> Column:
    """Placeholders replaced one after the other; what is put in early is looked at again by the later ones."""
    for name, value in values:
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def question_prompt(template: Column, page_text: Column, selected: Column, question: Column, history: Column) -> Column:
    """The request for an answer about a page: the filled template, with the turns before as a part of the page's text. Without a selection the template loses its quotation of it."""
    chosen = T.strip(F.coalesce(selected, F.lit("")))
    head = F.when(chosen != "", HISTORY_HEAD).otherwise(FOLLOW_UP_HEAD)
    turns = F.when(F.size(history) > 0, F.concat(F.lit("\n\n"), head, F.lit('\n"""\n'), F.array_join(history, "\n\n"), F.lit('\n"""'))).otherwise("")
    quoted = F.when(chosen != "", template).otherwise(F.regexp_replace(template, f"(?i){QUOTED_SELECTION}", "\n"))
    return filled_template(quoted, [("selected_text", chosen), ("page_text", F.concat(F.coalesce(page_text, F.lit("")), turns)), ("question", T.strip(question))])


def section_prompt(template: Column, chapter: Column, section: Column, first: Column, last: Column, text: Column) -> Column:
    return filled_template(template, [("chapter_title", F.concat(chapter, F.lit(" - "), section)), ("start_page", first), ("end_page", last), ("content_text", text)])


def chapter_question_text(notes_json: Column, section: Column) -> Column:
    """The note of a section, or all notes behind their titles, for questions about a chapter."""
    notes = F.from_json(notes_json, NOTES)
    chosen = F.filter(notes, lambda n: section.isNull() | (n["section_index"] == section))
    return F.array_join(F.transform(chosen, lambda n: F.concat(F.lit("## "), F.coalesce(n["section_title"], F.lit("")), F.lit("\n\n"), F.coalesce(n["note"], F.lit("")))), "\n\n---\n\n")


def is_persian(language: Column) -> Column:
    return F.lower(T.strip(language)).isin(*PERSIAN_NAMES)


# Providers.


class Provider(Protocol):
    """What a model must offer: translations of a batch of prompts, in order."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


PROVIDERS: dict[str, Callable[[], Provider]] = {}


def register(name: str, factory: Callable[[], Provider]) -> None:
    """Make a provider known under the name that profiles use; ``factory`` runs once in each task."""
    PROVIDERS[name] = factory


def answered(df: DataFrame, prompt: str, provider: Callable[[], Provider], name: str = "answer", batch: int = 16, retries: int = 1, pause: float = 2.0) -> DataFrame:
    """``df`` with the provider's answers. A call that fails is made again up to ``retries`` times, ``pause`` seconds later; then the task fails.

    Calls happen once per row and task attempt; write the result before using it twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider()
        for frame in frames:
            asked = frame[prompt].tolist()
            out: list[str] = []
            for k in range(0, len(asked), batch):
                prompts = [None if p is None or p != p else p for p in asked[k : k + batch]]
                for left in range(retries, -1, -1):
                    try:
                        out += ask(prompts)
                        break
                    except Exception:
                        if not left:
                            raise
                        time.sleep(pause)
            yield frame.assign(**{name: out})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{name}` string")


def mock_translation(text: Column, terms: Column) -> Column:
    """A stand-in for a model, line by line: headings get a suffix, other lines a prefix and the glossary's terms; blank lines and lines that are only a placeholder stay.

    ``terms`` are best those that the text holds (``glossary.with_terms``), as each line looks for all of them.
    """

    def with_terms(line: Column) -> Column:
        return F.aggregate(
            terms,
            F.concat(F.lit(MOCK_PREFIX), line),
            lambda acc, g: F.when(
                F.contains(F.lower(line), F.lower(g["source_term"])),
                F.replace(acc, g["source_term"], F.when(g["both"], F.concat(g["target_term"], F.lit(" ("), g["source_term"], F.lit(")"))).otherwise(g["target_term"])),
            ).otherwise(acc),
        )

    def put(line: Column) -> Column:
        return F.when(T.strip(line) == "", "").when(line.rlike(r"^\s*\[\[(?:CODE|IMAGE)_BLOCK_[0-9]+\]\]\s*$"), line).when(line.startswith("#"), F.concat(line, F.lit(MOCK_SUFFIX))).otherwise(with_terms(line))

    return F.array_join(F.transform(F.split(T.strip(text), "\n"), put), "\n")


def translated(pages: DataFrame, clean: bool = True) -> DataFrame:
    """``page_id``, ``translation``, ``asked`` of (``page_id``, ``source_text``, ``terms``): pages of only code or images pass through, others are masked, translated by the stand-in, restored and cleaned."""
    rows = pages.select("page_id", "source_text", "terms", M.only_code_or_media("source_text").alias("media"))
    masked = rows.withColumn("code", M.blocks("source_text", M.FENCED)).withColumn("coded", M.masked_code("source_text"))
    masked = masked.withColumn("tags", M.blocks("coded", M.IMAGE)).withColumn("m", F.when(~F.col("media"), M.masked_images("coded")))
    said = masked.withColumn("m", mock_translation(F.col("m"), F.col("terms")))
    back = repair.blocks_back(repair.blocks_back(said, "m", "tags", "coded", "IMAGE"), "m", "code", "source_text", "CODE")
    done = repair.clean_markdown(back, "m") if clean else back
    return done.select("page_id", F.when(F.col("media"), T.strip("source_text")).otherwise(F.col("m")).alias("translation"), (~F.col("media")).alias("asked"))


def attempts(made: DataFrame, earlier: DataFrame, provider: str, model: str) -> DataFrame:
    """Rows for the attempts that translations (``page_id``, ``translation``, ``asked``) are: numbered after the ``earlier`` ones of their page, not approved."""
    counts = earlier.select("id", "page_id").distinct().groupBy("page_id").agg(F.count("*").alias("n"))
    asked = lambda a, b: F.when(F.col("asked"), a).otherwise(b)
    return made.join(counts, "page_id", "left").select(
        "page_id", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("version_number"), asked(provider, PASSED_THROUGH).alias("provider_name"), asked(model, "N/A").alias("model_name"),
        F.col("translation").alias("raw_response"), F.col("translation").alias("edited_text"), F.lit(False).alias("is_approved"),
    )


# Notes of chapters.


def cached_notes(sections: DataFrame, notes: DataFrame) -> DataFrame:
    """Sections with the note kept for them, by title, else by number; a title that is known wins even if its note is empty.

    Two equi-joins instead of one on either condition. ``sections``: project_id,
    chapter, section, title; ``notes``: project_id, chapter, section_index,
    section_title, note.
    """
    by_title = notes.where("section_title is not null").groupBy("project_id", "chapter", F.col("section_title").alias("title")).agg(F.max_by("note", "section_index").alias("by_title"), F.lit(True).alias("known"))
    by_index = notes.groupBy("project_id", "chapter", F.col("section_index").alias("section")).agg(F.max("note").alias("by_index"))
    joined = sections.join(by_title, ["project_id", "chapter", "title"], "left").join(by_index, ["project_id", "chapter", "section"], "left")
    return joined.withColumn("note", T.filled(F.when(F.col("known"), F.col("by_title")).otherwise(F.col("by_index")))).drop("by_title", "by_index", "known")


def open_sections(sections: DataFrame, notes: DataFrame) -> DataFrame:
    """Sections that still need a note."""
    return cached_notes(sections, notes).where("note is null").drop("note")


def made_notes(sections: DataFrame, notes: DataFrame, template: Column, provider: Callable[[], Provider]) -> DataFrame:
    """Notes of all sections (project_id, chapter, section, title, first_page, last_page, words, text): those kept in ``notes``, and new ones for the rest.

    An answer that only acknowledges is asked for once more with a stricter request;
    if that helps nothing, the first answer stays. New notes are cleaned as Persian
    Markdown. Append the result to the table of notes: a run that follows asks for
    what is still open only, so a run that was cut short is taken up where it stopped.
    """
    held = cached_notes(sections, notes)
    prompt = F.concat(section_prompt(template, F.col("chapter"), F.col("title"), F.col("first_page"), F.col("last_page"), F.col("text")), F.lit(f"\n\n{NOTES_ONLY}"))
    asked = answered(held.where("note is null").drop("note").withColumn("prompt", prompt), "prompt", provider, "first")
    canned = M.is_canned("first")
    again = answered(asked.withColumn("strict", F.when(canned, F.concat(F.lit(f"{STRICT}\n\n"), "prompt"))), "strict", lambda: skipping_null(provider()), "second")
    better = canned & T.has_text("second") & ~M.is_canned("second")
    made = repair.clean_markdown(again.withColumn("note", F.when(better, F.col("second")).otherwise(F.coalesce("first", F.lit("")))), "note")
    columns = ["project_id", "chapter", "section", "title", "first_page", "last_page", "words"]
    return held.where("note is not null").select(*columns, "note").unionByName(made.select(*columns, T.strip("note").alias("note")))


def skipping_null(ask: Provider) -> Provider:
    """A provider that is not bothered with missing prompts."""

    def run(prompts: list[str | None]) -> list[str | None]:
        given = iter(ask([p for p in prompts if p is not None]))
        return [None if p is None else next(given) for p in prompts]

    return run


def finished_sections(notes: DataFrame) -> DataFrame:
    """``project_id``, ``chapter``, ``done``, ``progress`` of notes as of ``made_notes``: sections that have one, and the per cent shown."""
    done, total = F.count_if(F.col("note") != ""), F.count("*")
    return notes.groupBy("project_id", "chapter").agg(done.alias("done"), total.alias("total")).select("project_id", "chapter", "done", progress(F.col("done"), F.col("total")).alias("progress"))


def progress(done: Column, total: Column) -> Column:
    """Per cent shown after ``done`` of ``total`` sections: 5 at the start, 10 to 100 on the way."""
    return F.when(total <= 0, 5).when(done <= 0, 10).when(done >= total, 100).otherwise(10 + F.floor(done * 90 / total)).cast("int")
