"""leadlake: DataFrame operators for contact, company and scoring tables."""
