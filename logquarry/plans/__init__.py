"""Whole queries put together from sources and operators. Every plan is lazy."""
