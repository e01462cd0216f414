"""DataFrame to DataFrame steps from flows to rules, policies, evidence and health."""
