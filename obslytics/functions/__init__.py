"""obslytics.functions"""
