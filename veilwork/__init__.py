"""Find, replace and count sensitive information in text and page tables on Spark."""

from veilwork.plans.pages import deidentify_pages
from veilwork.plans.text import count_entities, deidentify_text, find_entities, findings

__all__ = ["count_entities", "deidentify_pages", "deidentify_text", "find_entities", "findings"]
