"""Road-network audits as Spark DataFrame plans, and operators for preparing training text (``waymeter.llm``)."""
