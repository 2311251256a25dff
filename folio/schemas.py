"""Schemas of the tables and the rules between page states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns of the stored tables, in order.
TABLES = {
    "translation_profiles": "id string, name string, source_language string, target_language string, provider_type string, model_name string, system_prompt string, temperature double, created_at timestamp, updated_at timestamp",
    "glossary_items": "id string, project_id string, source_term string, target_term string, include_parenthesis_english boolean, notes string, created_at timestamp",
    "projects": "id string, title string, source_pdf_filename string, source_pdf_path string, storage_dir string, source_type string, source_url string, total_pages int, source_language string, target_language string, profile_id string, created_at timestamp, updated_at timestamp",
    "pages": "id string, project_id string, page_number int, status string, source_text string, image_path string, thumbnail_path string, latest_translation string, approved_text string, created_at timestamp, updated_at timestamp",
    "translation_attempts": "id string, page_id string, project_id string, page_number int, version_number int, provider_name string, model_name string, prompt_used string, raw_response string, edited_text string, is_approved boolean, operator_notes string, created_at timestamp",
    "prompt_templates": "id string, name string, description string, template string, is_default boolean, created_at timestamp, updated_at timestamp",
    "page_conversations": "id string, project_id string, page_number int, selected_text string, question string, answer string, prompt_template_id string, created_at timestamp",
    "chapter_summaries": "id string, project_id string, chapter_title string, start_page int, end_page int, source_type string, prompt_template_id string, chunk_notes_json string, final_summary string, status string, progress_percent int, progress_message string, error_message string, created_at timestamp, updated_at timestamp",
    "chapter_prompt_templates": "id string, name string, description string, chunk_template string, is_default boolean, created_at timestamp, updated_at timestamp",
    "chapter_conversations": "id string, chapter_summary_id string, section_index int, selected_text string, question string, answer string, prompt_template_id string, created_at timestamp",
}
#: Notes of a chapter, kept as JSON.
NOTES = "array<struct<section_index:int,section_title:string,start_page:int,end_page:int,word_count:int,note:string>>"
#: Which state may follow which.
TRANSITIONS = {
    "PENDING": ("READY", "FAILED"),
    "READY": ("APPROVED_FOR_TRANSLATION", "PENDING", "FAILED"),
    "APPROVED_FOR_TRANSLATION": ("TRANSLATING", "READY", "APPROVED_FOR_TRANSLATION", "FAILED"),
    "TRANSLATING": ("TRANSLATED", "IN_REVIEW", "FAILED"),
    "TRANSLATED": ("IN_REVIEW", "APPROVED", "APPROVED_FOR_TRANSLATION", "FAILED"),
    "IN_REVIEW": ("APPROVED", "APPROVED_FOR_TRANSLATION", "TRANSLATING", "FAILED"),
    "APPROVED": ("EXPORTED", "IN_REVIEW", "APPROVED_FOR_TRANSLATION"),
    "EXPORTED": ("APPROVED", "IN_REVIEW"),
    "FAILED": ("READY", "APPROVED_FOR_TRANSLATION", "TRANSLATING"),
}


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, after in TRANSITIONS.items() for b in after], "from_status string, to_status string")


def with_schema(df: DataFrame, name: str) -> DataFrame:
    """A table in its schema: missing columns are null, further ones are left out."""
    from pyspark.sql import functions as F

    fields = [f.strip().rsplit(" ", 1) for f in TABLES[name].split(",")]
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields))
