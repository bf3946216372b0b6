"""Logical plans: the chain of steps behind a frame, and its normal form."""

from weftline.plans.steps import Step, Tail, normal_form

__all__ = ["Step", "Tail", "normal_form"]
