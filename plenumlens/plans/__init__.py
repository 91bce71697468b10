"""Queries by operator name."""

from plenumlens.plans import event_queries, member_queries, page_queries, text_queries
from plenumlens.plans.registry import REGISTRY
from plenumlens.plans.text_queries import best_fragments

__all__ = ["REGISTRY", "best_fragments", "event_queries", "member_queries", "page_queries", "text_queries"]
