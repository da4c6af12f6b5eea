"""Month-partitioned tables, matrices and the configuration grid."""
