"""leafmill: page-capture reconciliation and corpus assembly, expressed as Spark DataFrame plans."""
