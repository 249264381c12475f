"""Evaluation, risk, portfolio, selection and allocation operators over long-form tables."""
