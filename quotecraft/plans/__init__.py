"""End-to-end compositions of the operators.

- ``study``            ``Study``: both paths of the study as lazy DataFrames;
                       ``store_base`` / ``Study.with_stored_base`` write base tables once
- ``portfolio_study``  ``PortfolioStudy``: fixed or sampled portfolios, split, solve, evaluate
- ``run_study``        the whole study end to end, every output written (also a CLI)
"""
