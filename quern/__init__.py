"""quern: a PySpark-native relational, index and corpus analytics engine."""
