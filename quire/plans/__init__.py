"""Plans composed of operators: questions to evidence, compile layers."""
