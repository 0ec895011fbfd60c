"""Study configuration and the pipeline that composes the operators."""
