"""DataFrame operators of factor research: panels, evaluation, displacement, ranking, liquidations, signals, comparison."""
