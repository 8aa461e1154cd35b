"""Whole models: from a panel to the result tables a report needs."""
