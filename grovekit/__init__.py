"""grovekit: taxonomies, their texts and the tables around them, as Spark plans."""
