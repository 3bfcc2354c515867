"""Column expressions: numeric (bins, clip/round, scorecard), text (blank, length, amounts, verdicts, context) and vectors (dot, norm, keyword embedder)."""
