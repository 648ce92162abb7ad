"""dossier: a Spark engine for people-and-organisation records."""
